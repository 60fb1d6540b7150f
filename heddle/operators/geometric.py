"""Geometric diversity of vectors. What has a closed form is one aggregation; the rest compares blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.tables import materialize
from . import sampling


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def gram(df: DataFrame, vector: str, unit: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X (d by d), the sum of the rows and their number: partial sums per task, added up in Spark. Rows without a vector are left out; without rows all are 0."""

    def run(batches):
        g = s = None
        n = 0
        for b in batches:
            x = vectors.matrix(b.column(0))
            if len(x):
                x = _unit(x) if unit else x
                g, s, n = (x.T @ x, x.sum(axis=0), len(x)) if g is None else (g + x.T @ x, s + x.sum(axis=0), n + len(x))
        if g is not None:
            d = len(s)
            flat = np.concatenate([g.ravel(), s, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d + d + 1)), pa.array(flat)], names=["i", "v"])

    parts = df.select(vector).filter(F.col(vector).isNotNull()).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # d * d + d + 1 rows
    if not parts:
        return np.zeros((0, 0)), np.zeros(0), 0
    v = np.array([r.v for r in parts])
    d = int((np.sqrt(4 * len(v) - 3) - 1) / 2)
    return v[: d * d].reshape(d, d), v[d * d : -1], int(v[-1])


def distsum_cosine(df: DataFrame, vector: str = "embedding") -> tuple[float, float]:
    """Sum of 1 - cos over all ordered pairs, and over N (N - 1): N^2 - |sum of unit vectors|^2."""
    _, s, n = gram(df, vector)
    total = n * n - float(s @ s)
    return total, total / (n * (n - 1)) if n > 1 else 0.0


def distsum_l2(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """distsum and distavg of Euclidean distances over all ordered pairs, block by block."""

    def kernel(_, x, others):
        total, own = 0.0, (x * x).sum(axis=1)[:, None]
        for _, y in others:
            sq = own + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
            total += float(np.sqrt(np.maximum(sq, 0)).sum())
        return pa.table({"s": [total]})

    n = df.filter(F.col(vector).isNotNull()).count()
    return vectors.compared(df, key, vector, kernel, "s double").agg(F.sum("s").alias("distsum"), (F.sum("s") / F.lit(max(1, n * (n - 1)))).alias("distavg"))


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 1, metric: str = "cosine", right: DataFrame | None = None) -> DataFrame:
    """key, rank, other and distance of each row's k nearest other rows (exact). Ties by the other's key."""

    def distances(x, y):
        if metric == "cosine":
            return 1 - x @ y.T
        return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T

    def kernel(ka, x, others):
        """Of each row's k nearest so far the farthest bounds what a further block can add."""
        x = _unit(x) if metric == "cosine" else x
        kept = [(np.zeros(0, np.int64), ka[:0], np.zeros(0))]
        bound = np.full(len(ka), np.inf)
        for kb, y in others:
            far = distances(x, _unit(y) if metric == "cosine" else y)
            m = min(k, len(kb))
            if np.isinf(bound).any():
                bound = np.minimum(bound, np.partition(np.where(ka[:, None] == kb[None, :], np.inf, far), m - 1, axis=1)[:, m - 1] if m == k else np.inf)
            near = far <= bound[:, None]
            if near.sum() > 8 * k * len(ka):  # of ties at the last place the least keys, so copies are no more than others
                order = np.argsort(kb, kind="stable")
                for r in np.flatnonzero(near.sum(axis=1) > k + 1):
                    of = order[near[r, order]]
                    near[r, of[np.argsort(far[r, of], kind="stable")[k + 1 :]]] = False  # one more, as the row itself may be among them
            i, j = np.nonzero(near)
            other = ka[i] != kb[j]
            i, j = i[other], j[other]
            i, o, d = (np.concatenate(c) for c in zip(kept[0], (i, kb[j], far[i, j]), strict=True))
            order = np.lexsort((o, d, i))
            i, o, d = i[order], o[order], d[order]
            start = np.searchsorted(i, np.arange(len(ka)))
            few = (np.arange(len(i)) - start[i] < k) & np.isfinite(d)
            last = start + k - 1
            full = np.append(start[1:], len(i)) - start >= k
            bound[full] = d[last[full]]
            kept = [(i[few], o[few], d[few])]
        i, o, d = kept[0]
        return pa.table({"key": ka[i], "other": o, "distance": d})

    found = vectors.compared(df, key, vector, kernel, "key {key}, other {key}, distance double", right=right)
    order = F.row_number().over(Window.partitionBy("key").orderBy("distance", "other"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k).withColumnRenamed("key", key)


def radius(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The geometric mean of the dimensions' standard deviations."""
    per = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.stddev_samp(F.col("x").cast("double")).alias("sd"))
    return per.agg(F.exp(F.avg(F.log(F.greatest("sd", F.lit(1e-12))))).alias("radius"), F.avg("sd").alias("mean_sd"), F.stddev_pop("sd").alias("sd_of_sd"))


def inertia(df: DataFrame, class_id: str, vector: str = "embedding") -> DataFrame:
    """Summed squared distance to the class centroids."""
    return vectors.with_small(df, vectors.centroids(df, class_id, vector), class_id).agg(F.sum(F.pow(vectors.euclidean(F.col(vector), F.col("centroid")), F.lit(2.0))).alias("inertia"))


def density(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, power: float = 0.5, eps: float = 1e-9) -> DataFrame:
    """key and rho: 1 over the mean squared distance to the k nearest distinct other rows, to a power."""
    near = nearest(df, key, vector, k, "squared")
    return near.groupBy(key).agg((1 / F.pow(F.avg(F.greatest("distance", F.lit(0.0))) + eps, F.lit(power))).alias("rho"))


def novelsum(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, density_power: float = 0.5, power: float = 1.0) -> DataFrame:
    """Mean over rows of their density times the rank-weighted mean of distances to all rows, itself included.

    Weights 1 / rank^power by rising distance need a row's whole list of distances. A task makes those of a few rows, so
    many that the lists take 128 MB, sorts them and returns one number a row.
    """
    n = df.filter(F.col(vector).isNotNull()).count()
    rho = density(df, key, vector, k, density_power)

    def kernel(ka, x, others):
        x, far, at = _unit(x), np.empty((len(ka), n)), 0
        for kb, y in others:
            here = far[:, at : at + len(kb)]
            np.subtract(1, x @ _unit(y).T, out=here)
            here[ka[:, None] == kb[None, :]] = 0.0
            at += len(kb)
        far.sort(axis=1)
        w = 1 / np.arange(1, n + 1) ** power
        return pa.table({"key": ka, "m": far @ (w / w.sum())})

    rows = max(1, min(512, (1 << 24) // max(1, n)))
    mean = vectors.compared(df, key, vector, kernel, "key {key}, m double", rows=rows, held=None)
    return mean.select(F.col("key").alias(key), "m").join(rho, key).agg(F.avg(F.col("m") * F.col("rho")).alias("novelsum"))


def logdet(df: DataFrame, vector: str = "embedding", ridge: float = 1e-6) -> float:
    """log det of the m by m similarity matrix of unit rows plus a ridge, by way of the d by d Gram matrix."""
    g, _, m = gram(df, vector)
    d = len(g)
    if not m:
        return 0.0
    return float((m - d) * np.log(ridge) + np.linalg.slogdet(ridge * np.eye(d) + g)[1])


def logdet_draws(df: DataFrame, order: list[str], vector: str = "embedding", size: int = 512, trials: int = 5, ridge: float = 1e-6, seed: int = 42) -> list[float]:
    """The log-determinant of each of ``trials`` draws of ``size`` rows without replacement, by places in ``order``.

    Only drawn places go to the driver. Rows without a vector count for no place; of fewer than ``size`` rows, all are drawn.
    """
    rows = materialize(sampling.placed(df.filter(F.col(vector).isNotNull()), order, "_at").select("_at", vector))
    n, rng = rows.count(), np.random.default_rng(seed)
    drawn = [(t, int(at)) for t in range(trials) for at in rng.choice(n, size=min(size, n), replace=False)] if n else []
    of = materialize(rows.join(F.broadcast(df.sparkSession.createDataFrame(drawn, "trial int, _at long")), "_at"))
    return [logdet(of.filter(F.col("trial") == t), vector, ridge) for t in range(trials)]


def coverage(df: DataFrame, chosen: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Facility location: the sum and the mean of each row's greatest cosine with a chosen row."""

    def kernel(ka, x, others):
        u = _unit(x)
        return pa.table({"key": ka, "best": np.max([(u @ _unit(y).T).max(axis=1) for _, y in others], axis=0)})

    best = vectors.compared(df, key, vector, kernel, "key {key}, best double", right=chosen).groupBy("key").agg(F.max("best").alias("best"))
    return best.agg(F.sum("best").alias("coverage"), F.avg("best").alias("mean_coverage"))
