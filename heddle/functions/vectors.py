"""Vector algebra on array columns, and blocked comparison of all rows with all rows."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def normalized(a: Column) -> Column:
    """Length 1; a zero vector stays."""
    n = norm(a)
    return F.element_at(F.transform(F.array(n), lambda m: F.transform(a, lambda x: F.when(m > 0, x / m).otherwise(x.cast("double")))), 1)


def finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def repaired(a: Column, value: float = 1e-10) -> Column:
    return F.transform(a, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(value)).otherwise(x))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and centroid: means per place, summed map-side, so a large class is no hot task."""
    place = df.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return place.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def with_small(df: DataFrame, small: DataFrame, key: str, most: int = 100_000, salts: int = 64) -> DataFrame:
    """``df`` joined with a table that has a row per ``key``: broadcast up to ``most`` rows, beyond it dealt by key and a salt, so a frequent key is many tasks."""
    if small.limit(most + 1).count() <= most:
        return df.join(F.broadcast(small), key)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def compared(df: DataFrame, key: str, vector: str, kernel: Callable, schema: str, rows: int = 2048, right: DataFrame | None = None, held: int | None = 32 << 20) -> DataFrame:
    """``kernel(keys, X, others)`` for blocks of about ``rows`` rows; ``others`` yields the keys and the matrix of each block of other rows.

    Blocks travel once, as one packed row each. The cartesian product has a task read some blocks and up to ``held`` bytes of
    others from where they were dealt, so no pair of blocks is shuffled or written, and no task or driver holds all vectors; a kernel is called once for
    a block and each of these parts. The blocks are in at most 48 parts, or as many as keep each below 32 MB, so up to 1.5 GB of vectors the
    others are read 48 times, however many blocks there are. With ``held`` None the one call for a block sees all others. With ``right`` the rows of ``df`` are compared with those of
    another table with the same columns. Rows without a vector are left out. Keys may be of any type; ``{key}`` in the
    schema stands for it.
    """
    kind = df.schema[key].dataType.simpleString()
    kind = "long" if kind in ("int", "smallint", "tinyint", "bigint") else kind
    item = "f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "f8"
    df = df.filter(F.col(vector).isNotNull())
    other = df if right is None else right.filter(F.col(vector).isNotNull())
    n, width = df.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    m = n if right is None else other.count()
    parts = 1 if held is None else max(1, -(-m * width * int(item[1]) // held))
    ddl = f"keys array<{kind}>, x binary"

    def packed(d: DataFrame, most: int, tasks: int) -> DataFrame:
        def run(batches):
            keys, xs, count = [], [], 0
            for b in batches:
                keys.append(b.column(0))
                xs.append(matrix(b.column(1)).astype(item))
                count += b.num_rows
            if not count:
                return
            keys, x = pa.concat_arrays(keys), np.concatenate([v for v in xs if len(v)])
            cut = np.linspace(0, count, max(1, -(-count * 4 // (most * 5))) + 1).astype(np.int32)  # a block may have a quarter more rows
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                one = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), keys.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([one, pa.array([x[a:b].tobytes()], pa.binary())], names=["keys", "x"])

        return d.select(F.col(key).cast(kind).alias("k"), F.col(vector).alias("v")).repartition(tasks, F.xxhash64("k", "v")).mapInArrow(run, ddl)

    tasks = max(1, min(-(-n // min(rows, 256)), max(48, -(-n * width * int(item[1]) // (32 << 20)))))
    a = packed(df, rows, tasks).select(F.monotonically_increasing_id().alias("_at"), F.col("keys").alias("_ka"), F.col("x").alias("_xa"))
    b = packed(other, 2048, parts).select(F.col("keys").alias("_kb"), F.col("x").alias("_xb"))

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = schema.replace("{key}", kind)
    names = to_arrow_schema(T.StructType.fromDDL(schema)).names

    def block(batch, i, at):
        k = batch.column(at)[i].values
        return k.to_numpy(zero_copy_only=False), np.frombuffer(batch.column(at + 1)[i].as_buffer(), item).astype(np.float64).reshape(len(k), -1)

    def run(batches):
        rows_ = ((b, i, int(at)) for b in batches for i, at in enumerate(b.column(0).to_numpy()))
        for _, of in itertools.groupby(rows_, key=lambda r: r[2]):  # the rows of a block follow each other
            b, i, _ = first = next(of)
            out = kernel(*block(b, i, 1), (block(b, i, 3) for b, i, _ in itertools.chain([first], of)))
            yield from out.select(names).to_batches()

    return a.crossJoin(b.hint("shuffle_replicate_nl")).mapInArrow(run, schema)
