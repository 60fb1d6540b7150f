"""A corpus pipeline of five stages, each an operator of ``heddle.llm`` over all that the one before it kept.

Every stage takes (spark, docs, sf_dir), and all but the last return the columns of ``docs``, whatever else they hold. A stage's
result is written as Parquet to the shared folder and read again, so a lost executor repeats one stage at most; the
table of the stage before it is then deleted. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import parity_join, quality_knn, queries, secret_cnn, sentencepiece_codec, source_mix
from heddle.llm.shared import discard, materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Each row is judged by its text; null and empty texts by the share of good labels."""
    model = quality_knn.learn(docs, table(spark, sf_dir, "labels"))
    return quality_knn.score(docs, model, names=("__score", "__predicted")).filter("__predicted = 1").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by 3-word shingles at a Jaccard similarity of 0.9 the one with the least doc_id stays.

    Documents are told apart by doc_id: rows that repeat one stay or go together. Texts without words, and rows without a doc_id, stay.
    """
    links = parity_join.link_components(docs, k=3, percent=90)
    return docs.join(links.filter("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are replaced in the texts; n_chars follows. Null texts stay null, and so does their n_chars; no row goes."""
    return secret_cnn.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; cut where a source's target ends. Texts without words are never taken; a null source is one of its own."""
    return source_mix.mixed(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (``piece_ids``) in place of the texts, with their number and hashes; a row of the mix each, null and empty texts as the end id."""
    return sentencepiece_codec.encode(docs, queries.piece_model(), ids=True).drop("text")


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("secret_scans", redact_secrets),
    ("source_mix", mix_sources),
    ("sentencepiece", encode),
]

#: The classifier, the network and the tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
