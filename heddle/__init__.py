"""Curation and diversity analytics for instruction-tuning corpora on Spark."""
