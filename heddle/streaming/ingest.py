"""Incremental ingest: new files become canonical records once, without exact duplicates within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, text: str, time: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).withColumn("text_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).dropDuplicatesWithinWatermark(["text_hash"])


def ingest(spark: SparkSession, path: str, schema: str, text: str, out: str, checkpoint: str, delay: str = "1 hour", files: str = "*.parquet") -> StreamingQuery:
    """Runs over all files of a folder there are now (those whose names match ``files``), then stops; a later run with the same checkpoint goes on from there."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(path).withColumn("seen_at", F.current_timestamp())
    return deduplicated(stream, text, "seen_at", delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
