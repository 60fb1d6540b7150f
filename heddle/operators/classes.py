"""Semantic classes of vectors: principal components, k-means, and a pluggable classifier."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import geometric

#: A classifier takes rows with a vector and adds an integer column ``sem_id``; noise is a class of its own.
Classifier = Callable[[DataFrame], DataFrame]


def components(df: DataFrame, vector: str = "embedding", share: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, principal axes (one a row) up to the first place where ``share`` of the variance is reached, and all shares."""
    g, s, n = geometric.gram(df, vector, unit=False)
    mean = s / n
    values, axes = np.linalg.eigh(g / n - np.outer(mean, mean))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1].T
    part = values / max(values.sum(), 1e-300)
    cut = min(int(np.searchsorted(np.cumsum(part), share - 1e-12)) + 1, len(part))
    return mean, axes[:cut], part


def projected(df: DataFrame, mean: np.ndarray, axes: np.ndarray, vector: str = "embedding", out: str = "projected") -> DataFrame:
    """Coordinates on the axes, as Column expressions."""
    shift = axes @ mean
    parts = [vectors.dot(F.col(vector), F.array(*[F.lit(float(v)) for v in a])) - F.lit(float(c)) for a, c in zip(axes, shift, strict=True)]
    return df.withColumn(out, F.array(*parts))


def kmeans(df: DataFrame, k: int, vector: str = "embedding", seeds: tuple[int, ...] = (42,), steps: int = 20, unit: bool = False) -> tuple[DataFrame, float]:
    """Rows with ``sem_id``, and the inertia of the best of several starts. Vectors of length 0 keep it when scaled."""
    x = vectors.normalized(F.col(vector)) if unit else F.transform(vector, lambda v: v.cast("double"))
    rows = df.withColumn("_x", array_to_vector(x))
    models = [KMeans(k=k, seed=s, maxIter=steps, featuresCol="_x", predictionCol="sem_id").fit(rows) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).drop("_x"), float(best.summary.trainingCost)


def pca_kmeans(k: int, share: float = 0.9, vector: str = "embedding", seed: int = 42) -> Classifier:
    """The default classifier: axes up to a share of the variance, then k-means."""

    def classify(df: DataFrame) -> DataFrame:
        mean, axes, _ = components(df, vector, share)
        return kmeans(projected(df, mean, axes, vector, "_p"), k, "_p", (seed,))[0].drop("_p")

    return classify


def given(column: str) -> Classifier:
    """Classes that another tool found; null is noise and becomes one more class."""
    return lambda df: df.withColumn("sem_id", F.coalesce(F.col(column).cast("int"), F.lit(-1)))


def centers(df: DataFrame, class_id: str = "sem_id", vector: str = "embedding") -> DataFrame:
    return vectors.centroids(df, class_id, vector)


