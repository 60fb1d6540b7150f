"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source, its documents in shuffled order, form a stream that starts again after its end. A mix
of T words is a row of T / BLOCK slots; slot j falls on the golden-ratio point j * phi mod 1, and the
source in whose share of the unit interval the point lies fills it with the next block of its stream
(the block of the slot's rank among the source's slots). Each source's last slot holds only the words
that its target still asks for, and the few slots that a share misses by its discrepancy come last.

Everything is DataFrame operations. Offsets in a stream are sums in two levels, over hash ranges of a source
and within one, so a source with a third of all rows is never sorted in one task; ranks of slots in
the same way over runs of slots. Every row keeps a number of its own, so rows that repeat a doc_id, or all
columns, are apart. Null texts have size 0, take nothing and are returned; null sources are one source, the last, and null
doc_ids are rows like others. Reruns agree, as the order comes from hashes of doc_id, the size and the text (rows equal in these are
interchangeable). Empty tables give empty results. Input columns may have any names; only windows over one row per source run in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Words in a block, slots in a run, cells of the unit interval in which points look for their source.
BLOCK, RUN, CELLS = 512, 4096, 4096
#: Names beside those of the input.
ROW, PASS, SIZE = "__mix_row", "__mix_pass", "__mix_size"
#: The golden ratio as a multiplier modulo 2**31: odd, so all residues occur.
GOLDEN, MODULUS = 1327217885, 1 << 31


def targets(sizes: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, source_size, target of sources (one row each, with ``source_size``).

    Shares of percent/100 of all words by weight; a source stops at ``most`` times its size and what it leaves
    goes to the others by weight. The level is found in closed form: sources fill up in the order of
    size / weight, and the level is the first that the next source does not reach.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    by = Window.orderBy(F.col("source_size") * 1.0 / F.col("weight"), "k")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"total": F.sum("source_size").over(whole), "full": F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)), "rest": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))})
    level = (F.col("total") * F.lit(percent) / 100.0 - F.col("full")) / F.col("rest")
    rows = rows.withColumn("level", F.when(level * F.col("weight") <= F.col("source_size") * most, level))
    rows = rows.withColumn("level", F.first("level", ignorenulls=True).over(Window.orderBy(F.col("source_size") * 1.0 / F.col("weight"), "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    cap = (F.col("source_size") * most).cast("double")
    return rows.select("source", "k", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def schedule(shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, k, rank and words of every slot of a mix: ``shares`` has k and target, one row per source."""
    spark = shares.sparkSession
    need = shares.select("k", F.floor("target").cast("long").alias("words")).filter("words > 0")
    total = need.agg(F.sum("words")).first()[0] or 0
    slots = -(-total // block)
    ends = need.withColumn("end", F.sum("words").over(Window.orderBy("k")) * 1.0 / F.lit(float(total or 1)))
    ends = ends.withColumn("start", F.coalesce(F.lag("end").over(Window.orderBy("k")), F.lit(0.0)))
    cell = lambda c: F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1))
    bounds = ends.select(F.explode(F.sequence(cell("start"), cell("end"))).alias("cell"), F.struct("end", "k").alias("e")).groupBy("cell").agg(F.sort_array(F.collect_list("e")).alias("b"))  # an entry per source, and one per cell
    point = F.pmod(F.pmod(F.col("id"), F.lit(MODULUS)) * F.lit(GOLDEN), F.lit(MODULUS)) / F.lit(float(MODULUS))
    drawn = spark.range(slots).select("id", point.alias("x")).withColumn("cell", cell("x")).join(bounds, "cell")
    drawn = drawn.select(F.col("id").alias("slot"), F.expr("element_at(filter(b, e -> e.end > x), 1).k").alias("k"), F.floor(F.col("id") / RUN).alias("run"))
    counts = drawn.groupBy("k", "run").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("k", "run").orderBy("slot")) - 1
    drawn = drawn.withColumn("r", rank).join(counts, ["k", "run"]).select("slot", "k", (F.col("r") + F.col("before")).alias("rank"))
    got = counts.groupBy("k").agg(F.sum("n").alias("n"))
    missed = need.join(got, "k", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "all": F.ceil(F.col("words") / block)}).filter("n < all")
    missed = missed.select(F.lit(slots).alias("slot"), "k", F.explode(F.expr("sequence(n, all - 1)")).alias("rank"))
    every = drawn.unionByName(missed).join(need, "k").filter(F.col("rank") * block < F.col("words"))
    return every.select("slot", "k", "rank", F.least(F.lit(block), F.col("words") - F.col("rank") * block).cast("long").alias("words"))


def streams(rows: DataFrame, seed: int) -> DataFrame:
    """Appends ``at``, the place of a document's first word in its source's shuffled stream, to rows with doc_id, source, size and mark."""
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed))))
    ranged = rows.withColumns({"h": order, "range": F.substring(order, 1, 3)})
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("source", "range").orderBy("h", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = ranged.withColumn("inside", inner)
    cond = ranged["source"].eqNullSafe(sums["source"]) & (ranged["range"] == sums["range"])
    return ranged.join(sums, cond).select(*(ranged[c] for c in rows.columns), (F.col("before") + F.col("inside")).alias("at"))


def size_of(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _base(docs: DataFrame, row, doc_id: str, text: str, source: str) -> DataFrame:
    """What the plan needs of each row: its number, doc_id, source, size, and a hash of the text that orders repeated doc_ids."""
    return docs.select(row.alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("mark"))


def _plan(base: DataFrame, percent: int = 150, most: int = 2, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """Rows of ``base`` (a written table) with source_size, target, at, taken and passes."""
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = materialize(targets(sizes, percent, most))
    rows = streams(base, seed)
    named = rows.join(shares, rows["source"].eqNullSafe(shares["source"])).select(*(rows[c] for c in rows.columns if c != "mark"), "k", "source_size", "target")
    named = materialize(named)
    spans = named.filter("size > 0").withColumn("pass", F.explode(F.expr(f"sequence(0, {most - 1})"))).withColumn("start", F.col("pass") * F.col("source_size") + F.col("at")).filter("start < target")
    parts = spans.select("row", "k", "size", "pass", "start", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("rank"))
    taken = parts.join(schedule(shares, block), ["k", "rank"])
    first, last = F.greatest("start", F.col("rank") * block), F.least(F.col("start") + F.col("size"), F.col("rank") * block + F.col("words"))
    got = taken.withColumns({"first": first - F.col("start"), "n": last - first}).filter("n > 0")
    per_pass = got.groupBy("row", "pass").agg(F.sum("n").alias("words"), F.min("first").alias("first"), F.min_by("slot", "first").alias("slot"))
    per_row = per_pass.groupBy("row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("pass", "first", "words", "slot"))).alias("passes"))
    return named.join(per_row, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc_id, source, size, source_size, target, at, taken and passes of every row.

    ``taken`` counts the words the mix takes of a document, repeats included; ``passes`` has a struct for each pass through
    the stream that takes some: pass, the first word taken, how many, and the slot of the mix that takes the first.
    Options: percent, most, block, seed.
    """
    base = materialize(_base(docs, F.monotonically_increasing_id(), doc_id, text, source))
    return _plan(base, **options).select("doc_id", "source", "size", "source_size", "target", "at", "taken", "passes")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", order: str | None = None, **options) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a row of ``docs``, with all its columns.

    A document of which a pass takes only a part (at the end of a source's target) is cut to those words, one
    blank between them. ``docs`` is written once with a number for each row, by which rows and plan are matched. ``order``
    names a further column with the slot of the row's first word: sorted by it, any long stretch of the mix is near the weights.
    """
    whole = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()))
    base = materialize(_base(whole, F.col(ROW), doc_id, text, source))
    plan = _plan(base, **options).filter("taken > 0").select(F.col("row").alias(ROW), F.explode("passes").alias(PASS), F.col("size").alias(SIZE))
    words = F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), (F.col(f"{PASS}.first") + 1).cast("int"), F.col(f"{PASS}.words").cast("int"))
    cut = F.when(F.col(f"{PASS}.words") == F.col(SIZE), F.col(text)).otherwise(F.array_join(words, " "))
    slot = [F.col(f"{PASS}.slot").alias(order)] if order else []
    return whole.join(plan, ROW).select(*(cut.alias(c) if c == text else F.col(c) for c in docs.columns if c != order), *slot)


ORACLE = r"""
WITH b AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':7') AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM b GROUP BY source),
w AS (SELECT *, [5, 2, 1][(k - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
  coalesce(sum(source_size * 2) OVER (ORDER BY source_size * 1.0::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
  sum(weight) OVER (ORDER BY source_size * 1.0::DOUBLE / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest FROM w),
v AS (SELECT *, (total * 150 / 100.0::DOUBLE - filled) / rest AS level FROM o),
n AS (SELECT *, first_value(CASE WHEN level * weight <= source_size * 2 THEN level END IGNORE NULLS) OVER (ORDER BY source_size * 1.0::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM v),
t AS (SELECT source, source_size, least((source_size * 2)::DOUBLE, coalesce(lv * weight, (source_size * 2)::DOUBLE)) AS target FROM n),
a AS (SELECT b.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(floor(target)::BIGINT, off + size) - off) + greatest(0, least(floor(target)::BIGINT, source_size + off + size) - (source_size + off)))::BIGINT AS taken FROM a"""
