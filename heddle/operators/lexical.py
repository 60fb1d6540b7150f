"""Lexical diversity of a column of token arrays: one aggregation over n-grams each."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngram_hashes


#: Buckets of n-grams by the leading bits of their hashes, and the n-grams that a task holds before it counts them.
BITS, HELD = 10, 1 << 21


def _packed(x: np.ndarray) -> bytes:
    """Bytes place by place, so that the shuffle's compression finds the empty ones."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpacked(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def profile(df: DataFrame, tokens: Column, sizes: list[int], threshold: int = 100) -> DataFrame:
    """Per n and bucket of n-grams: how many there are (total) and how many different (d), the sum of c log2 c over their
    counts c (s), and how many occur ``threshold`` times or less (r).

    N-grams are 64-bit hashes. A task counts two million at a time and sends each bucket's as two packed columns, the gaps
    of the sorted hashes and the counts: about six bytes an n-gram.
    """

    def count(batches):
        held: dict = {n: [] for n in sizes}

        def sent(n):
            grams, c = np.unique(np.concatenate(held[n]), return_counts=True)
            held[n] = []
            at = np.flatnonzero(np.diff(grams >> np.uint64(64 - BITS), prepend=np.uint64(1 << 63)))
            rows = [(int(grams[a] >> np.uint64(64 - BITS)), _packed(np.diff(grams[a:b], prepend=np.uint64(0))), _packed(c[a:b].astype(np.uint32))) for a, b in zip(at, [*at[1:], len(grams)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([n] * len(rows), pa.int32()), *[pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]], names=["n", "bucket", "grams", "counts"])

        for batch in batches:
            lists = batch.column(0)
            w = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            long_ = np.fromiter((len(x) for x in lists), int, len(lists)) if lists.null_count else np.diff(lists.offsets.to_numpy())
            left = np.repeat(np.cumsum(long_), long_) - np.arange(len(w))  # words to the end of the row
            h = np.full(len(w), 0x9E3779B97F4A7C15, np.uint64)
            for n in range(1, max(sizes) + 1):
                h = (h[: max(0, len(w) - n + 1)] ^ w[n - 1 :]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
                if n in held:
                    ok = h[left[: len(h)] >= n]
                    if len(ok):
                        held[n].append(ok * np.uint64(0xC4CEB9FE1A85EC53))  # the leading bits deal out the buckets
                        if sum(map(len, held[n])) >= HELD:
                            yield sent(n)
        for n in sizes:
            if held[n]:
                yield sent(n)

    def merged(t: pa.Table) -> pa.Table:
        grams = np.concatenate([np.cumsum(_unpacked(b, np.uint64), dtype=np.uint64) for b in t["grams"].to_pylist()])
        c = np.concatenate([_unpacked(b, np.uint32) for b in t["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(grams)
        grams, c = grams[order], c[order]
        c = np.add.reduceat(c, np.flatnonzero(np.append(True, grams[1:] != grams[:-1])))
        return pa.table({"n": t["n"][:1], "d": [len(c)], "total": [int(c.sum())], "s": [float((c * np.log2(c)).sum())], "r": [int(c[c <= threshold].sum())]})

    words = df.select(F.transform(tokens, lambda x: F.xxhash64(x)).alias("w"))
    sent = words.mapInArrow(count, "n int, bucket int, grams binary, counts binary")
    return sent.groupBy("n", "bucket").applyInArrow(merged, "n int, d long, total long, s double, r long")


def entropy(df: DataFrame, tokens: Column, n: int) -> DataFrame:
    """Entropy of the n-gram distribution in bits, and how many n-grams there are."""
    # sum -(c/N) log2(c/N) = log2 N - sum c log2 c / N: one pass, no second join with the total
    return profile(df, tokens, [n]).agg(F.sum("total").alias("total"), F.sum("s").alias("s")).select((F.log2("total") - F.col("s") / F.col("total")).alias("entropy"), "total")


def distinct(df: DataFrame, tokens: Column, n: int) -> DataFrame:
    """The share of distinct n-grams among all."""
    return profile(df, tokens, [n]).agg((F.sum("d") / F.sum("total")).alias("distinct_n"), F.sum("total").alias("total"))


def low_frequency(df: DataFrame, tokens: Column, threshold: int = 100) -> DataFrame:
    """The share of tokens that occur ``threshold`` times or less in the corpus."""
    return profile(df, tokens, [1], threshold).agg((F.sum("r") / F.sum("total")).alias("low_frequency"))


def ngram_diversity(df: DataFrame, tokens: Column, most: int = 4) -> DataFrame:
    """The mean of the shares of distinct n-grams for n = 1 to ``most``."""
    parts = profile(df, tokens, list(range(1, most + 1))).groupBy("n").agg((F.sum("d") / F.sum("total")).alias("distinct_n"))
    return parts.agg(F.avg("distinct_n").alias("ngram_diversity"))


def type_counts(f) -> Callable[[Column], Column]:
    """``f`` of the number of tokens and of each type's count, for every row; None for a row without tokens. Types are 64-bit hashes, so no text goes to Python."""

    def run(rows: pa.Array) -> pa.Array:
        def one(t):
            w = t.values.to_numpy() if t.is_valid else ()
            return f(len(w), np.unique(w, return_counts=True)[1]) if len(w) else None

        return pa.array([one(t) for t in rows], pa.float64())

    return lambda tokens: F.arrow_udf(run, "double")(F.transform(tokens, lambda x: F.xxhash64(x)))


def expected_ttr(df: DataFrame, tokens: Column, key: str, size: int = 30) -> DataFrame:
    """Per row the expected type-token ratio of ``size`` tokens drawn without replacement, in closed form.

    The chance that none of a type's c tokens is drawn from N is a product of (N - c - i) / (N - i).
    A row with fewer tokens uses all of them; one with none has no ratio.
    """

    def ratio(n, c):
        if n <= size:
            return len(c) / n
        miss = np.prod((n - c[:, None] - np.arange(size)).clip(0) / (n - np.arange(size)), axis=1)
        return float((1 - miss).sum() / size)

    return df.select(key, type_counts(ratio)(tokens).alias("ttr"))


def vocd(df: DataFrame, tokens: Column, key: str, least: int = 50) -> DataFrame:
    """Per row of at least ``least`` tokens the D that fits its expected ratios at 35 to 50 tokens.

    The model is TTR(N) = D / N (sqrt(1 + 2 N / D) - 1); least squares by golden section over log D.
    """
    sizes = np.arange(35, 51)

    def curve(c, n):
        lg = np.vectorize(math.lgamma, otypes=[float])
        kinds, often = np.unique(c, return_counts=True)
        out = []
        for s in sizes:
            rest = n - kinds
            ok = rest >= s
            miss = np.zeros(len(kinds))
            miss[ok] = np.exp(lg(rest[ok] + 1) - lg(rest[ok] - s + 1) - math.lgamma(n + 1) + math.lgamma(n - s + 1))
            out.append((1 - np.repeat(miss, often)).sum() / s)
        return np.array(out)

    def fit(seen):
        """Of all rows of a batch at once."""
        loss = lambda x: ((np.exp(x)[:, None] / sizes * (np.sqrt(1 + 2 * sizes / np.exp(x)[:, None]) - 1) - seen) ** 2).sum(axis=1)
        lo, hi, g = np.full(len(seen), math.log(0.01)), np.full(len(seen), math.log(1e4)), (math.sqrt(5) - 1) / 2
        for _ in range(80):
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            down = loss(a) < loss(b)
            lo, hi = np.where(down, lo, a), np.where(down, b, hi)
        return np.exp((lo + hi) / 2)

    @F.arrow_udf("double")
    def fitted(rows: pa.Array) -> pa.Array:
        out, seen, at = np.full(len(rows), np.nan), [], []
        for i, t in enumerate(rows):
            w = t.values.to_numpy() if t.is_valid else ()
            if len(w) >= least:
                seen.append(curve(np.unique(w, return_counts=True)[1], len(w)))
                at.append(i)
        if at:
            out[at] = fit(np.array(seen))
        return pa.array(out, from_pandas=True)  # NaN, where nothing was fitted, is null

    return df.select(key, fitted(F.transform(tokens, lambda x: F.xxhash64(x))).alias("d")).filter("d IS NOT NULL")


def sentence_bleu(references: list[list[str]], hypothesis: list[str], most: int = 4) -> float:
    """BLEU of one sentence; an n-gram order without a match counts 0.1 matches."""
    if not hypothesis:
        return 0.0
    logs = 0.0
    for n in range(1, most + 1):
        grams = lambda t, n=n: pd.Series([tuple(t[i : i + n]) for i in range(len(t) - n + 1)], dtype=object).value_counts()
        h = grams(hypothesis)
        best: dict = {}
        for r in references:
            for g, c in grams(r).items():
                best[g] = max(best.get(g, 0), c)
        hit = sum(min(c, best.get(g, 0)) for g, c in h.items())
        logs += math.log((hit or 0.1) / max(1, h.sum())) / most
    near = min((abs(len(r) - len(hypothesis)), len(r)) for r in references)[1]
    return math.exp(logs) * (1.0 if len(hypothesis) > near else math.exp(1 - near / len(hypothesis)))


def self_bleu(sentences: list[list[str]]) -> float:
    """The mean BLEU of each sentence against all others; for stated, small sets."""
    return float(np.mean([sentence_bleu(sentences[:i] + sentences[i + 1 :], s) for i, s in enumerate(sentences)]))


def pairwise_bleu(sentences: list[list[str]]) -> float:
    """The mean BLEU of each sentence against each other one alone; for stated, small sets."""
    return float(np.mean([sentence_bleu([r], s) for i, s in enumerate(sentences) for j, r in enumerate(sentences) if i != j]))


def report(df: DataFrame, tokens: Column, group: str, most: int = 3, threshold: int = 100) -> DataFrame:
    """Per group and n: distinct_n, entropy in bits, total, and for n = 1 the share of rare tokens. One pass over the grams."""
    rows = F.array(*[F.struct(F.lit(n).alias("n"), ngram_hashes(tokens, n).alias("g")) for n in range(1, most + 1)])
    grams = df.select(group, F.inline(rows)).select(group, "n", F.explode("g").alias("gram"))
    c = grams.groupBy(group, "n", "gram").agg(F.count("*").alias("c"))
    rare = F.sum(F.when(F.col("c") <= threshold, F.col("c")).otherwise(0))
    s = c.groupBy(group, "n").agg(F.count("*").alias("d"), F.sum("c").alias("total"), F.sum(F.col("c") * F.log2("c")).alias("s"), rare.alias("r"))
    return s.select(group, "n", (F.col("d") / F.col("total")).alias("distinct_n"), (F.log2("total") - F.col("s") / F.col("total")).alias("entropy"), "total", F.when(F.col("n") == 1, F.col("r") / F.col("total")).alias("low_frequency"))
