"""Text functions as Column expressions; NFKC and windows of characters are Arrow UDFs, over a few megabytes of text at a time."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import bounded

#: Control characters that cleaning drops: all of C0 but tab and line feed, and DEL. A fixed value.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: A token is a run of word characters or one other sign.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def mapped(texts: pa.Array, f, kind: pa.DataType) -> pa.Array:
    """``f`` of each text; only a few megabytes of them are Python objects at a time."""
    parts = [pa.array([f(t) for t in b.column(0).to_pylist()], kind) for b in bounded(pa.RecordBatch.from_arrays([texts], ["t"]), 0)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return mapped(texts, lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), pa.string())


def clean(c: Column) -> Column:
    """NFKC, line ends as line feeds, no control characters, no Unicode white space at the ends; null gives the empty text."""
    c = F.regexp_replace(nfkc(F.coalesce(c.cast("string"), F.lit(""))), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(c, CONTROL, ""), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def window_hashes(text: str, n: int) -> np.ndarray:
    """Windows of n characters as 64-bit hashes, in order; none of a shorter text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m = max(0, len(c) - n + 1)
    h = np.full(m, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(n):
        h = (h ^ c[k : k + m]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def char_ngram_count(c: Column, n: int) -> Column:
    """How many distinct windows of n characters there are; none in a shorter text. Windows are compared by 64-bit hashes."""
    count = lambda t: 0 if t is None else len(np.unique(window_hashes(t, n)))
    return F.arrow_udf(lambda texts: mapped(texts, count, pa.int64()), "long")(c)


def hashed_ngrams(c: Column, n: int) -> Column:
    """Distinct windows of n characters as 64-bit hashes: a third of the windows' own size where sets are shuffled."""
    made = lambda t: np.unique(window_hashes(t or "", n)).view(np.int64)
    return F.arrow_udf(lambda texts: mapped(texts, made, pa.list_(pa.int64())), "array<bigint>")(c)


def ngrams(items: Column, n: int) -> Column:
    """Windows of n items joined by a blank, repeats kept. ``items`` is bound once, whatever its cost."""
    if n == 1:
        return items

    def joined(w: Column) -> Column:
        out = w
        for k in range(1, n):  # shifted arrays are joined place by place: no array is made for each window
            out = F.zip_with(F.slice(out, F.lit(1), F.size(w) - k), F.slice(w, F.lit(k + 1), F.size(w) - k), lambda x, y: F.concat(x, F.lit(" "), y))
        return F.when(F.size(w) >= n, out).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(items), joined), 1)


def ngram_hashes(items: Column, n: int) -> Column:
    """Windows of n items as 64-bit hashes, repeats kept: to be counted without their texts. ``items`` is bound once."""

    def joined(w: Column) -> Column:
        out = w
        for k in range(1, n):
            out = F.zip_with(F.slice(out, F.lit(1), F.size(w) - k), F.slice(w, F.lit(k + 1), F.size(w) - k), lambda x, y: F.xxhash64(x, y))
        return F.when(F.size(w) >= n, out).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(F.transform(items, lambda x: F.xxhash64(x))), joined), 1)


def base_hash(c: Column) -> Column:
    """The first four bytes of SHA-1 as a little-endian unsigned number."""
    h = F.sha1(c.cast("binary"))
    return F.conv(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")


def hex_halves(c: Column) -> tuple[Column, Column]:
    """The high and the low 64 bits of 32 hexadecimal digits as whole numbers."""
    half = lambda k: F.conv(F.substring(c, k, 16), 16, 10).cast("decimal(38,0)")
    return half(1), half(17)
