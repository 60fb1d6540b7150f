"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are hashed: byte runs of 2 to 4, words in lower case and pairs of words, as square roots of their
shares, and four terms for repetition (adjacent words, three-word runs, lines, shortness). Terms are weighted
by the inverse document frequencies of a bounded sample of labelled texts, and the sample's leading singular vectors
are the latent dimensions. The labelled vectors are broadcast, every document is compared with all of them by cosine in
blocks, and its nearest ``k`` vote with weights of similarity.

A null or empty text has no direction; it gets the share of good labels in the sample. Of repeated labels
of a document the mean holds, of repeated documents the least text is learned from; each row is scored. Ties at the k-th place all
vote. Without labels of both kinds every score is that share (1 where there are none at all). An empty table gives an
empty result; input columns named like a new one are replaced (``names`` gives other names), all others stay.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import append, pieces, spread, trained_on

#: Hashed terms of byte runs and of words, each a power of two, and those for repetition.
BITS = 10
RUNS, WORDS, REPEATS = 1 << BITS, 1 << BITS, 4
TERMS = RUNS + WORDS + REPEATS
#: Labelled texts to learn from, for each label: a bound of the fit, whatever the input.
SAMPLE = 2000
RANK, NEIGHBOURS, SHARPNESS = 64, 25, 4.0
U = np.uint32
MULTIPLY = U(2654435761)


def _hashed(codes: np.ndarray, salt: int) -> np.ndarray:
    return (codes + U(salt)) * MULTIPLY >> U(32 - BITS)


def terms(text: str | None) -> np.ndarray:
    """Weights of a text's terms before those of the sample: square roots of shares."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    data = text.encode()
    c = np.frombuffer(data, np.uint8).astype(U)
    two = c[:-1] << U(8) | c[1:]
    three = two[:-1] << U(8) | c[2:]
    four = three[:-1] << U(8) | c[3:]
    runs = np.concatenate([_hashed(two, 1), _hashed(three, 0x9E3779B9), _hashed(four, 0x7F4A7C15)])
    out[:RUNS] = np.sqrt(np.bincount(runs, minlength=RUNS) / len(c))
    words = data.split()
    n = len(words)
    if n:
        h = np.fromiter(map(zlib.crc32, data.lower().split()), U, n)
        out[RUNS : RUNS + WORDS] = np.sqrt(np.bincount(np.concatenate([_hashed(h, 0), _hashed(h[:-1] * U(31) + h[1:], 0)]), minlength=WORDS) / n)
        same = sum(map(bytes.__eq__, words, words[1:]))
        again = n - 2 - len(set(zip(words, words[1:], words[2:]))) if n > 2 else 0
        lines = [x for x in data.split(b"\n") if x.strip()]
        out[RUNS + WORDS :] = np.sqrt([same / n, again / n, 1 - len(set(lines)) / len(lines), min(1.0, 5 / n)])
    return out


@dataclass
class Model:
    """What is broadcast: at most 2 * SAMPLE vectors of RANK numbers, and their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    k: int = NEIGHBOURS

    def embed(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors of latent dimensions; zeros for a text without terms."""
        return unit((x * self.weights) @ self.axes)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.prior)
        # one row at a time would add up in the same order; the cosines are rounded so that ties are ties
        near = np.round(self.embed(x) @ self.vectors.T, 5)
        k = min(self.k, near.shape[1])
        least = np.partition(near, -k, axis=1)[:, -k:-k + 1 or None].min(axis=1, keepdims=True)
        weight = np.where(near >= least, np.maximum(near, 0).astype(np.float64) ** SHARPNESS, 0)
        # a text without terms has cosine 0 with all, so its weights are 0 and the prior holds
        return np.clip((weight @ self.labels + 1e-6 * self.prior) / (weight.sum(axis=1) + 1e-6), 0, 1)


def fit(x: np.ndarray, labels: np.ndarray, rank: int = RANK, k: int = NEIGHBOURS) -> Model:
    """Inverse document frequencies and the latent space of labelled term vectors, and their place in it."""
    prior = float(labels.mean()) if len(labels) else 1.0
    if len(labels) < 2 or labels.min() == labels.max():
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior, k)
    weights = np.maximum(np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))), 0.05).astype(np.float32)
    weights[RUNS + WORDS :] = 1
    x = x * weights  # one further copy of the bounded sample, in single precision
    axes = leading(x, rank)
    return Model(weights, axes, unit(x @ axes), labels.astype(np.float64), prior, k)


def unit(v: np.ndarray) -> np.ndarray:
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def leading(z: np.ndarray, rank: int, steps: int = 4, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors of z as columns, by subspace iteration from a fixed start."""
    q = np.random.default_rng(seed).normal(size=(z.shape[1], min(rank + 16, *z.shape))).astype(np.float32)
    for _ in range(steps):
        q = np.linalg.qr(z.T @ (z @ q))[0]
    return (q @ np.linalg.svd(z @ q, full_matrices=False)[2].T)[:, :rank].astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """doc_id, text and y of at most ``per_label`` labelled documents of each kind, all from the learning rows."""
    rows = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(trained_on(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    of = lambda good: rows.filter((F.col("y") >= 0.5) == F.lit(good)).orderBy(spread(F.col("doc_id")), "doc_id").limit(per_label)
    chosen = docs.select("doc_id", "text").join(F.broadcast(of(True).union(of(False))), "doc_id")  # 2 * per_label ids
    return chosen.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))  # of an id one text, so the bound holds


def _sparse(batches):
    """doc_id, y, and the places and weights of the terms of each text that are not 0."""
    for batch in batches:
        for part in pieces(batch, 256, "text"):
            x = [terms(t) for t in part.column("text").to_pylist()]
            at = [np.flatnonzero(v).astype(np.uint16) for v in x]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([v[a].astype(np.float16).tobytes() for v, a in zip(x, at, strict=True)], pa.binary())], names=["doc_id", "y", "at", "weight"])


def learn(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Model:
    """Terms are counted on the executors; only those of the bounded sample come to the driver, as sparse vectors."""
    rows = sample(docs, labels, per_label).select("doc_id", "text", "y")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(_sparse, f"doc_id {kind}, y double, at binary, weight binary").toArrow().sort_by("doc_id")  # 2 * per_label rows
    x = np.zeros((rows.num_rows, TERMS), np.float32)
    for k, (at, weight) in enumerate(zip(rows["at"], rows["weight"], strict=True)):
        x[k, np.frombuffer(at.as_buffer(), np.uint16)] = np.frombuffer(weight.as_buffer(), np.float16)
    y = rows["y"].to_numpy().astype(float)
    del rows
    return fit(x, y)


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Appends score (0 to 1, higher is better) and predicted (1 where score >= threshold)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value

        def run(texts):
            s = m.score(np.array([terms(t) for t in texts], np.float32).reshape(len(texts), TERMS))
            return [s, (s >= threshold).astype(np.int32)]

        return run

    return append(df, text, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())], make, rows=512)
