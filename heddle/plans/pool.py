"""The candidate pool: validate, decontaminate, deduplicate, allot quotas, sample, export, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages as M
from ..operators import dedup, sampling
from ..sources import tables

STAGE_FILES = ("canonical", "messages", "sft", "docs", "metadata")


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records without a reason, and counts of the others by reason."""
    return records.filter("reason IS NULL").drop("reason"), records.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def build(records: DataFrame, dev: DataFrame | None, target: int, seed: int = 42, near: bool = True, threshold: float = 0.8, window: int = 5, priority: str | None = None, base: int = 500, dev_id: str = "sample_id") -> dict[str, DataFrame]:
    """``pool`` (with candidate_index) and what each stage removed.

    ``records``: sample_id, source, messages, reason. ``dev``: a table with ``doc``, which must not occur; with ``prompt``
    and ``dev_id`` too, equal and similar first prompts go as well. ``priority`` is an SQL expression, lower first; ``base`` is each source's base quota.
    """
    valid, invalid = split_valid(records)
    rows = tables.materialize(valid.withColumns({"doc": M.document(F.col("messages")), "prompt": M.first_user_prompt(F.col("messages")), "priority": F.expr(priority or "0")}))
    removed = {"invalid": invalid}
    if dev is not None and "prompt" in dev.columns:
        found = tables.materialize(dedup.contamination(rows, dev, "sample_id", "doc", "prompt", dev_id, threshold, window))
        removed["contaminated"] = found
        rows = rows.join(found.select("sample_id"), "sample_id", "left_anti")
    elif dev is not None:
        clean = dedup.without_contamination(rows, "doc", dev, "doc")
        removed["contaminated"] = rows.join(clean.select("sample_id"), "sample_id", "left_anti").select("sample_id")
        rows = clean
    order = ["priority", "source"]
    if near:
        found = tables.materialize(dedup.near(rows, "sample_id", "doc", order, threshold, window=window))
        removed["duplicates"] = found.filter("NOT kept").drop("kept")
        rows = rows.join(found.filter("kept").select("sample_id"), "sample_id")
    else:
        rows, removed["duplicates"] = dedup.exact(rows, "doc", order, "sample_id")
    rows = tables.materialize(rows)
    counts = {r.source: r.n for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    quotas = sampling.source_quotas(counts, target, base)
    pool = sampling.quota_sample(rows, quotas, "sample_id", seed=seed)
    pool = sampling.placed(pool, ["source", "sample_id"], "candidate_index")
    return {"pool": tables.materialize(pool)} | removed


def export(spark: SparkSession, pool: DataFrame, path: str, mode: str = "errorifexists") -> dict:
    """Five row-aligned tables and a manifest with counts and hashes."""
    index = F.col("candidate_index").alias("row_index")
    shapes = {
        "canonical": pool.select(index, "sample_id", "source", "messages"),
        "messages": pool.select(index, "messages"),
        "sft": pool.select(index, "sample_id", "source", "messages"),
        "docs": pool.select(index, "sample_id", "doc"),
        "metadata": pool.select(index, "sample_id", "source", F.size("messages").alias("turns")),
    }
    for name, df in shapes.items():
        tables.write_jsonl(df, f"{path}/{name}", "row_index", mode)
    manifest = {"count": pool.count(), "sources": {r.source: r.n for r in pool.groupBy("source").agg(F.count("*").alias("n")).collect()}, "hashes": {n: tables.content_hash(df) for n, df in shapes.items()}}
    tables.write_manifest(spark, f"{path}/manifest", manifest)
    return manifest


def audit(pool: DataFrame, docs: DataFrame, expected: int | None = None) -> DataFrame:
    """check and failures: one row per invariant of a pool and its documents (sample_id, row_index, doc)."""
    checks = {
        "rows": pool.agg(F.abs(F.count("*") - F.lit(expected if expected is not None else 0)).cast("long").alias("failures")) if expected is not None else None,
        "duplicate_ids": pool.groupBy("sample_id").count().filter("count > 1").agg(F.count("*").alias("failures")),
        "invalid_messages": pool.filter(M.invalid_reason(F.col("messages")).isNotNull()).agg(F.count("*").alias("failures")),
        "misaligned": pool.select("sample_id", F.col("candidate_index").alias("i")).join(docs.select("sample_id", F.col("row_index").alias("i")).withColumn("there", F.lit(1)), ["sample_id", "i"], "full_outer").filter("there IS NULL").agg(F.count("*").alias("failures")),
        "places": pool.agg((F.max("candidate_index") + 1 - F.count("*")).cast("long").alias("failures")),
    }
    out = None
    for name, df in checks.items():
        if df is not None:
            row = df.select(F.lit(name).alias("check"), F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))
            out = row if out is None else out.unionByName(row)
    return out


def validation(records: DataFrame, n: int, seed: int = 42, pool: DataFrame | None = None) -> DataFrame:
    """``n`` rows (sample_id, source, messages, row_index) by the order of a hash, each sample_id once, without those that a pool holds by id or content."""
    rows = records.groupBy("sample_id").agg(F.min(F.struct("source", "messages")).alias("r")).select("sample_id", "r.*").withColumn("_key", M.key(F.col("messages")))
    if pool is not None:
        known = pool.select("sample_id", M.key(F.col("messages")).alias("_key"))
        reasons = sampling.exclusion_reasons(rows, known, "sample_id", "_key")
        rows = reasons.filter("reason IS NULL").drop("reason")
    return sampling.placed(sampling.hash_sample(rows, n, "sample_id", seed), ["sample_id"], "row_index").drop("_key")


def export_validation(spark: SparkSession, rows: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, str]:
    """The rows whole and as messages alone, in the same order; a hash of each."""
    rows = tables.materialize(rows)
    shapes = {"canonical": rows, "messages": rows.select("row_index", "messages")}
    for name, df in shapes.items():
        tables.write_jsonl(df, f"{path}/{name}", "row_index", mode)
    hashes = {name: tables.content_hash(df.withColumn("messages", F.to_json("messages"))) for name, df in shapes.items()}
    tables.write_manifest(spark, f"{path}/manifest", hashes)
    return hashes


def export_selection(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Selected rows in a folder for each group_id, as JSON lines."""
    tables.without_transient(rows).repartition("group_id").sortWithinPartitions("group_id", "candidate_index").write.mode(mode).partitionBy("group_id").json(path)
