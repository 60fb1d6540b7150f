"""Kernel and distribution metrics: Vendi score, internal diversity, MAUVE, partition entropy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometric


def renyi(p: np.ndarray, q: float = 1.0) -> float:
    """Rényi entropy of order q, natural logarithm; zeros count nothing."""
    p = np.asarray(p, float)
    p = p[p > 1e-12]
    if q == 1:
        return float(-(p * np.log(p)).sum())
    if q == np.inf:
        return float(-np.log(p.max()))
    return float(np.log((p**q).sum()) / (1 - q))


def vendi(k: np.ndarray, q: float = 1.0, p: np.ndarray | None = None) -> float:
    """exp of the entropy of the eigenvalues of a similarity matrix, scaled by n or by the weights p."""
    k = np.asarray(k, float)
    scaled = k / len(k) if p is None else k * np.sqrt(np.outer(p, p))
    return float(np.exp(renyi(np.linalg.eigvalsh(scaled), q)))


def vendi_of(samples: list, kernel, q: float = 1.0) -> float:
    """Of a small set of samples and a similarity function."""
    return vendi(np.array([[kernel(a, b) for b in samples] for a in samples]), q)


def vendi_dual(df: DataFrame, vector: str = "embedding", q: float = 1.0) -> float:
    """The cosine Vendi score from the d by d Gram matrix: its eigenvalues are those of the n by n kernel."""
    g, _, n = geometric.gram(df, vector)
    return float(np.exp(renyi(np.linalg.eigvalsh(g / n), q))) if n else 0.0


def internal_diversity(df: DataFrame, vector: str = "embedding") -> float:
    """1 - the mean cosine of all pairs = 1 - |mean unit vector|^2."""
    _, s, n = geometric.gram(df, vector)
    return 1 - float(s @ s) / (n * n) if n else 0.0


def histogram(df: DataFrame, key: str) -> DataFrame:
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("t")))).select(key, (F.col("n") / F.col("t")).alias("p"))


def partition_entropy(df: DataFrame, key: str) -> DataFrame:
    """Entropy in bits of the shares of a key."""
    return histogram(df, key).agg((-F.sum(F.col("p") * F.log2("p"))).alias("partition_entropy"))


def kl(p: np.ndarray, q: np.ndarray) -> float:
    """Kullback-Leibler divergence; infinite where q lacks what p has."""
    if (q[p > 0] == 0).any():
        return float("inf")
    both = p > 0
    return float((p[both] * np.log(p[both] / q[both])).sum())


def mauve(p: np.ndarray, q: np.ndarray, points: int = 25, scale: float = 5.0) -> float:
    """The area under the divergence curve of two histograms over mixtures of both."""
    w = np.linspace(1e-6, 1 - 1e-6, points)
    mixed = [x * p + (1 - x) * q for x in w]
    xs = np.exp(-scale * np.array([0, *(kl(q, r) for r in mixed), np.inf]))
    ys = np.exp(-scale * np.array([np.inf, *(kl(p, r) for r in mixed), 0]))
    # of points with equal first coordinates the highest comes first, as the curve falls
    area = lambda a, b: float(np.trapezoid(b[o := np.lexsort((-b, a))], a[o]))
    return 0.5 * (area(xs, ys) + area(ys, xs))


def head_weights(p: np.ndarray, beta: float = 1.0, head: float = 0.1) -> np.ndarray:
    """Instance weights (1 - p)^beta by class; -1 for head classes."""
    return np.where(p > head, -1.0, (1 - p) ** beta)


def tanimoto(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two bit sets as arrays of unsigned integers."""
    both, any_ = (int(np.bitwise_count(x).sum()) for x in (a & b, a | b))
    return both / any_ if any_ else 1.0


def ngram_vendi(sentences: list[list[str]], orders: tuple[int, ...] = (1, 2), q: float = 1.0) -> float:
    """The mean over n-gram orders of the Vendi score of cosines of n-gram counts; for stated, small sets of sentences."""
    scores = []
    for n in orders:
        grams = [[" ".join(s[i : i + n]) for i in range(len(s) - n + 1)] for s in sentences]
        names = {g: i for i, g in enumerate(sorted({g for s in grams for g in s}))}
        x = np.zeros((len(sentences), max(1, len(names))))
        for r, s in enumerate(grams):
            for g in s:
                x[r, names[g]] += 1
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        scores.append(vendi(u @ u.T, q))
    return float(np.mean(scores))
