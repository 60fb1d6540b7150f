"""Records of several public dialogue layouts as canonical rows: sample_id, source, messages, and a reason if invalid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.text import clean


def chat_rows(df: DataFrame, prefix: str, excluded: str = "oasst|openassistant") -> DataFrame:
    """Rows with id, source and messages (role, content); sources that match ``excluded`` and rows without a source get a reason."""
    turns = F.transform("messages", lambda m: F.struct(M.role(m["role"]).alias("role"), m["content"].alias("content")))
    reason = F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "missing_source").when(F.lower("source").rlike(excluded), "excluded_source")
    rows = df.withColumns({"turns": turns, "reason": reason})
    return rows.select(F.concat_ws("::", F.lit(prefix), "source", F.col("id").cast("string")).alias("sample_id"), "source", F.col("turns").alias("messages"), F.coalesce("reason", M.invalid_reason(F.col("turns"))).alias("reason"))


def instruction_rows(df: DataFrame, prefix: str, source: str, keep: list[str] | None = None) -> DataFrame:
    """Rows with instruction, input and output: instruction and input make the user turn; empty ones get a reason. Columns named in ``keep`` stay."""
    parts = {c: clean(F.col(c)) for c in ("instruction", "input", "output")}
    rows = df.withColumns({f"_{c}": x for c, x in parts.items()})
    user = F.when(F.col("_input") == "", F.col("_instruction")).otherwise(F.concat_ws("\n\n", "_instruction", "_input"))
    key = F.substring(F.sha2(F.to_json(F.struct(F.col("_input").alias("input"), F.col("_instruction").alias("instruction"), F.col("_output").alias("output"))), 256), 1, 16)
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    reason = F.when(F.col("_instruction") == "", "empty_instruction").when(F.col("_output") == "", "empty_output")
    return rows.select(F.concat_ws("::", F.lit(prefix), key).alias("sample_id"), F.lit(source).alias("source"), F.array(turn("user", user), turn("assistant", F.col("_output"))).alias("messages"), reason.alias("reason"), *(keep or []))


def best_paths(nodes: DataFrame) -> DataFrame:
    """message_tree_id and messages: in each tree of usable nodes the path of the best child at every step.

    Usable nodes are not deleted, not rejected and of a ready tree. The root is the prompter with the least
    id; below a node comes the child of the other role with the best rank (a rank before none), then the
    least id. The path ends at its last assistant. One join per level, over the nodes of that level only.
    """
    usable = nodes.filter("NOT (deleted <=> true) AND NOT (review_result <=> false) AND tree_state = 'ready_for_export' AND text IS NOT NULL AND message_id IS NOT NULL")
    expected = F.when(F.col("role") == "assistant", "prompter").otherwise("assistant")
    order = [F.col("rank").isNull(), F.col("rank"), F.col("message_id")]
    best = usable.filter("parent_id IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("message_tree_id", "parent_id", "role").orderBy(*order))).filter("_n = 1").drop("_n")
    roots = usable.filter("parent_id IS NULL AND role = 'prompter'").groupBy("message_tree_id").agg(F.min(F.struct("message_id", "role", "text")).alias("r"))
    level = roots.select("message_tree_id", "r.message_id", "r.role", "r.text", F.lit(0).alias("depth"))
    from .tables import materialize

    best = materialize(best.select("message_tree_id", "parent_id", F.col("message_id").alias("c_id"), F.col("role").alias("c_role"), F.col("text").alias("c_text")))
    every = level = materialize(level)
    while True:
        on = (F.col("l.message_tree_id") == F.col("b.message_tree_id")) & (F.col("l.message_id") == F.col("b.parent_id")) & (F.col("want") == F.col("b.c_role"))
        nxt = level.withColumn("want", expected).alias("l").join(best.alias("b"), on).select("l.message_tree_id", F.col("b.c_id").alias("message_id"), F.col("b.c_role").alias("role"), F.col("b.c_text").alias("text"), (F.col("l.depth") + 1).alias("depth"))
        level = materialize(nxt)
        if level.isEmpty():
            break
        every = every.unionByName(level)
    turns = every.groupBy("message_tree_id").agg(F.sort_array(F.collect_list(F.struct("depth", M.role(F.col("role")).alias("role"), clean(F.col("text")).alias("content")))).alias("t"))
    upto = F.expr("array_max(transform(filter(t, x -> x.role = 'assistant'), x -> x.depth)) + 1")
    cut = turns.withColumn("n", upto).filter("n IS NOT NULL")
    return cut.select("message_tree_id", F.expr("transform(slice(t, 1, n), x -> struct(x.role AS role, x.content AS content))").alias("messages")).filter(~F.exists("messages", lambda m: m["content"] == ""))


def original_stream(*pools: DataFrame) -> DataFrame:
    """The valid rows of several adapted pools, with ``pool``, the place of their pool; rows with a reason are left out."""
    out = None
    for k, rows in enumerate(pools):
        part = rows.filter("reason IS NULL").drop("reason").withColumn("pool", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out
