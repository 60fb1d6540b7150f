"""Language by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams (1 to 3 letters, words set off by one
boundary), most frequent first. The out-of-place distance of a document to a language sums, over the
document's profile, how far each n-gram stands from its place in the language's profile; one that is
not there counts the profile's length. The nearest language is predicted.

A text without a letter (or null, or empty) is ``und`` with score 0. N-grams of equal frequency rank by code
points, languages of equal distance by name. With no labelled rows every text is ``und``.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import append, pieces, spread, trained_on

#: N-grams in a profile.
PROFILE = 400
#: Learning texts per language (in expectation): a bound of the fit, whatever the input.
SAMPLE = 1500
U = np.uint64
EDGE = U(1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point 0, or the code point + 1 of a letter."""
    return np.fromiter((c + 1 if chr(c).isalpha() else 0 for c in range(sys.maxunicode + 1)), np.uint32, sys.maxunicode + 1)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams in code order and how often each occurs."""
    if not text:
        return np.empty(0, U), np.empty(0, np.int64)
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = c > 0
    if not letter.any():
        return np.empty(0, U), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first sign after a word is its boundary
    c = np.concatenate([[EDGE], np.where(letter, c + 1, 1)[keep].astype(U), [EDGE]])
    two = (c[:-1] << U(21)) | c[1:]
    three = (two[:-1] << U(21)) | c[2:]
    inner = c[1:-1] != EDGE
    # none with a boundary alone, or in its middle
    all_ = np.concatenate([c[c != EDGE], two[two != ((EDGE << U(21)) | EDGE)], three[inner]])
    all_.sort()
    first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
    return all_[first], np.diff(np.append(first, len(all_)))


def profile(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in the order of their ranks."""
    if len(codes) > size:
        least = np.partition(counts, -size)[-size]
        codes, counts = codes[held := counts >= least], counts[held]
    return codes[np.argsort(-counts, kind="stable")][:size]


class Model:
    """Profiles of the languages as one sorted table of n-grams and their ranks."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.names = size, sorted(profiles)
        self.codes = np.unique(np.concatenate([np.empty(0, U), *profiles.values()]))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), k] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(*grams(text), self.size)
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[(at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        rank = self.ranks[at]
        far = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(far.argmin())
        return self.names[best], 1.0 - float(far[best]) / (self.size * len(own))


def learn(docs: DataFrame, size: int = PROFILE, per_language: int = SAMPLE) -> Model:
    """Profiles from texts of known language among the learning rows of ``docs`` (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL").filter(trained_on(F.col("doc_id")))
    share = {r.lang: min(1.0, per_language / r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not share:
        return Model({}, size)
    wanted = F.create_map(*[F.lit(x) for kv in sorted(share.items()) for x in kv])[F.col("lang")]
    chosen = rows.filter(F.pmod(spread(F.col("doc_id")), F.lit(1 << 20)) < wanted * (1 << 20))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 512, "text"):
                texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
                names, codes, counts = [], [], []
                for lang in sorted(set(langs)):
                    got = [grams(t) for t, x in zip(texts, langs, strict=True) if x == lang]
                    held, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([g[1] for g in got]), len(held)).astype(np.int64)
                    names += [lang] * len(held)
                    codes.append(held.view(np.int64))
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))], names=["lang", "code", "n"])

    from pyspark.sql import Window

    total = chosen.select("text", "lang").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = total.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("k") <= size)
    found: dict[str, list] = {}
    for r in top.orderBy("lang", "k").collect():  # size rows a language
        found.setdefault(r.lang, []).append(r.code)
    return Model({k: np.array(v, np.int64).view(U) for k, v in found.items()}, size)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Appends lang_pred and score (1 less the distance's share of the largest possible)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        return lambda texts: list(zip(*[m.predict(t) for t in texts], strict=True)) or [[], []]

    return append(df, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, rows=512)
