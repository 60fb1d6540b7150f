"""Exact and near duplicates and contamination, in an order of priority.

The near-duplicate rule keeps a record unless it is similar to an earlier record that is kept. On the graph
of similar pairs that is the first maximal independent set in the order; it is found in rounds over
the links, each written to the shared folder.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_ngram_count, hashed_ngrams, window_hashes
from ..sources.tables import bounded, discard, materialize

PRIME = (1 << 61) - 1


def exact(df: DataFrame, text: str, order: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and removed rows with ``matched_id``: of equal texts one row stays, the first by ``order``, then the key.

    Rows are written once with a number each, so rows with a null key, or with the same key, are rows like others. Hashes,
    keys and order columns alone are compared; first rows are found by a map-side minimum, and whole rows then meet
    the numbers of those that go, so a text with very many copies is no hot task. A null text counts as empty.
    """
    whole = materialize(df.withColumns({"_row": F.monotonically_increasing_id(), "_h": F.sha2(F.coalesce(F.col(text), F.lit("")), 256)}))
    first = whole.groupBy("_h").agg(F.min(F.struct(*order, F.col(key).alias("_k"), "_row")).alias("_f"), F.count("*").alias("_n")).filter("_n > 1").select("_h", "_f._k", F.col("_f._row").alias("_first"))
    gone = materialize(whole.select("_h", "_row").join(first, "_h").filter("_row <> _first").select("_row", F.col("_k").alias("matched_id")))
    return whole.join(gone, "_row", "left_anti").select(*df.columns), whole.join(gone, "_row").select(*df.columns, "matched_id")


def without_contamination(df: DataFrame, text: str, other: DataFrame, other_text: str) -> DataFrame:
    """Rows whose text is not among those of ``other``, compared by hash; a null text counts as empty."""
    h = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")), 256).alias("_h")
    return df.withColumn("_h", h(text)).join(other.select(h(other_text)).distinct(), "_h", "left_anti").drop("_h")


def contamination(df: DataFrame, dev: DataFrame, key: str, doc: str, prompt: str, dev_key: str, threshold: float = 0.8, window: int = 5, **options) -> DataFrame:
    """key, matched_id, match_type and similarity of the rows that occur in ``dev`` (dev_key and the same two columns).

    An equal document comes before an equal prompt, that before a similar prompt (similarity given, to 6 places).
    Of several the least dev_key counts, of similar ones the most similar. Prompts shorter than the window
    have no shingles and are never similar. Each different prompt is compared once, however often it occurs.
    """
    h = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")), 256)
    rows = materialize(df.select(F.col(key), h(doc).alias("_d"), h(prompt).alias("_p")))
    by = lambda c, name: dev.groupBy(h(c).alias(name)).agg(F.min(dev_key).alias(f"m{name}"))
    exact_ = rows.join(by(doc, "_d"), "_d", "left").join(by(prompt, "_p"), "_p", "left")
    text = lambda d: d.select(h(prompt).alias("k"), F.coalesce(F.col(prompt), F.lit("")).alias("t")).filter(F.length("t") >= window).dropDuplicates(["k"])
    dev_text = materialize(text(dev))
    sizes = dev_text.agg(F.min(char_ngram_count(F.col("t"), window)).alias("least"), F.max(char_ngram_count(F.col("t"), window)).alias("most")).first()
    # a set that is smaller or larger than all of dev by more than the threshold is similar to none of them
    near_size = char_ngram_count(F.col("t"), window).between(math.floor(threshold * (sizes.least or 0)), math.ceil((sizes.most or 0) / threshold))
    here = materialize(text(df).join(dev_text.select("k"), "k", "left_anti").filter(near_size))
    a, b = (materialize(band_table(d, "k", "t", window, **options)) for d in (here, dev_text))
    pairs = a.select("band", "bucket", F.col("key").alias("a")).join(b.select("band", "bucket", F.col("key").alias("b")), ["band", "bucket"]).select("a", "b").distinct()
    side = lambda d, n: d.select(F.col("k").alias(n), hashed_ngrams(F.col("t"), window).alias(f"s{n}"))
    similarity = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    alike = pairs.join(side(here, "a"), "a").join(side(dev_text, "b"), "b").select("a", "b", similarity.alias("s")).filter(F.col("s") >= threshold)
    named = alike.join(by(prompt, "b"), "b").groupBy(F.col("a").alias("_p")).agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("mb").alias("m"))).alias("_n"))
    kind = F.when(F.col("m_d").isNotNull(), "exact_doc").when(F.col("m_p").isNotNull(), "exact_prompt").when(F.col("_n").isNotNull(), "prompt_minhash")
    near_only = F.col("m_d").isNull() & F.col("m_p").isNull()
    out = exact_.join(named, "_p", "left").select(key, F.coalesce("m_d", "m_p", "_n.m").alias("matched_id"), kind.alias("match_type"), F.when(near_only, F.round(-F.col("_n.s"), 6)).alias("similarity"))
    return out.filter("match_type IS NOT NULL")


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The multipliers and the offsets of n hash functions; all multipliers are drawn first."""
    r = np.random.RandomState(seed)
    return r.randint(1, PRIME, n, dtype=np.uint64), r.randint(0, PRIME, n, dtype=np.uint64)


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a * x mod 2**61 - 1 for a < 2**61 and x < 2**32, in 64-bit halves."""
    p, low = np.uint64(PRIME), np.uint64((1 << 32) - 1)
    hi, lo = (a >> np.uint64(32)) * x, (a & low) * x  # a x = hi 2**32 + lo, hi < 2**61
    hi = (hi >> np.uint64(29)) + ((hi & np.uint64((1 << 29) - 1)) << np.uint64(32))  # hi 2**32 mod p
    lo = (lo >> np.uint64(61)) + (lo & p)
    s = hi + lo
    s = (s >> np.uint64(61)) + (s & p)
    return np.where(s >= p, s - p, s)


class Hashes(dict):
    """The base hash of each shingle, made once: texts share most of theirs. Emptied when it is large."""

    def __missing__(self, s: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[s] = h = int.from_bytes(hashlib.sha1(s.encode()).digest()[:4], "little")
        return h


def signature(shingles, a: np.ndarray, b: np.ndarray, hashes: Hashes | None = None) -> np.ndarray:
    """The least permuted hash of the shingles under each function, as 32 bits; PRIME for no shingles."""
    if not len(shingles):
        return np.full(len(a), PRIME, np.uint64)
    return permuted(shingles, a, b, hashes).min(axis=0).astype(np.uint64)


def permuted(shingles, a: np.ndarray, b: np.ndarray, hashes: Hashes | None = None) -> np.ndarray:
    """The hash of each shingle under each function, as 32 bits: a row for each shingle."""
    x = np.array([*map((Hashes() if hashes is None else hashes).__getitem__, shingles)], np.uint64)
    out = np.empty((len(x), len(a)), np.uint32)
    for k in range(0, len(x), 64):
        v = _times(a[None, :], x[k : k + 64, None]) + b[None, :]
        out[k : k + 64] = np.where(v >= np.uint64(PRIME), v - np.uint64(PRIME), v) & np.uint64((1 << 32) - 1)
    return out


def band_table(df: DataFrame, key: str, text: str, window: int = 5, n: int = 256, bands: int = 32, seed: int = 42) -> DataFrame:
    """key, band and bucket: a row for each band of each text's signature."""
    a, b = permutations(n, seed)
    per = n // bands

    def run(batches):
        hashes = Hashes()
        for batch in (part for b_ in batches for part in bounded(b_, 1, most=2 << 20)):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            windows = [window_hashes(t or "", window) for t in texts]
            ends = np.cumsum([len(w) for w in windows])
            _, at, place = np.unique(np.concatenate(windows), return_index=True, return_inverse=True)
            row = np.searchsorted(ends, at, side="right")
            start = at - (ends - [len(w) for w in windows])[row]
            mixed = permuted([texts[r][i : i + window] for r, i in zip(row.tolist(), start.tolist(), strict=True)], a, b, hashes)
            sig = np.full((len(texts), n), PRIME, np.uint64)
            for r, of in enumerate(np.split(place, ends[:-1])):  # each shingle of the slice is permuted once
                if len(of):
                    sig[r] = mixed[np.unique(of)].min(axis=0)
            buckets = [hashlib.blake2b(sig[r, k * per : (k + 1) * per].tobytes(), digest_size=8).digest() for r in range(len(texts)) for k in range(bands)]
            rows = np.repeat(np.arange(len(texts)), bands)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(texts))), pa.array(np.frombuffer(b"".join(buckets), np.int64))], names=["key", "band", "bucket"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, band int, bucket long")


def deciding_pairs(df: DataFrame, key: str, text: str, order: list[str], threshold: float = 0.8, window: int = 5, first: int = 8, **options) -> DataFrame:
    """a, b and similarity of the similar pairs that the keep-first rule needs, a before b in ``order``."""
    return settled(df, key, text, order, threshold, window, first, **options)[0]


def settled(df: DataFrame, key: str, text: str, order: list[str], threshold: float = 0.8, window: int = 5, first: int = 8, **options) -> tuple[DataFrame, DataFrame]:
    """The pairs above, and key and kept of all rows that share a bucket with another.

    Members of a bucket are not all paired. In each round the first few undecided members of every bucket are
    compared with all later members; what is similar to a kept record is then gone and compares with none after
    it. A bucket of near copies costs a few comparisons a member; of a bucket whose members all stay, every pair
    is compared, as the rule asks. The number of members taken doubles with each round. Large buckets are dealt
    to many tasks by a share of the members' keys. Two empty sets count as similar 1.
    """
    bands = materialize(band_table(df, key, text, window, **options))
    bucket = ["band", "bucket"]
    sizes = bands.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1").select(*bucket, F.ceil(F.col("n") / 4096).cast("int").alias("shares"))
    rank = df.select(F.col(key).alias("key"), F.struct(*order, key).alias("o"))
    members = materialize(bands.join(sizes, bucket).join(rank, "key").withColumn("taken", F.lit(False)))
    state = materialize(members.select("key").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    sets = df.select(F.col(key).alias("k"), hashed_ngrams(F.col(text), window).alias("s"))
    side = lambda n: sets.select(F.col("k").alias(n), F.col("s").alias(f"s{n}"))
    both, all_ = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    similarity = F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)
    links, take = None, first
    while True:
        place = F.row_number().over(Window.partitionBy(*bucket).orderBy("o"))
        waiting = members.filter("NOT taken").join(state.filter("kept IS NULL").select("key"), "key", "left_semi")
        now = materialize(waiting.withColumn("place", place).filter(F.col("place") <= take).select("key", "o", "shares", *bucket))
        if now.isEmpty():
            break
        x = now.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(*bucket, "share", F.col("key").alias("a"), F.col("o").alias("oa"))
        y = members.select(*bucket, F.pmod(F.xxhash64("key"), F.col("shares")).cast("int").alias("share"), F.col("key").alias("b"), F.col("o").alias("ob"))
        pairs = x.join(y, [*bucket, "share"]).filter("oa < ob").select("a", "b").distinct()
        found = materialize(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= threshold))
        links = found if links is None else links.unionByName(found)
        before, old = members, state
        members = materialize(members.join(now.select("key", *bucket, F.lit(True).alias("now")), ["key", *bucket], "left").select("key", *bucket, "shares", "o", (F.col("taken") | F.coalesce("now", F.lit(False))).alias("taken")))
        state = _decided(members, state, links)
        discard(before, old, now)
        take = min(2 * take, 512)  # Spark cuts a window's input before the shuffle up to 1,000 places
    if links is None:
        return _no_pairs(df, key), state
    while not state.filter("kept IS NULL").isEmpty():  # chains of rows that wait for one another only
        old, state = state, _decided(members, state, links)
        discard(old)
    return links, state


def _decided(members: DataFrame, state: DataFrame, links: DataFrame) -> DataFrame:
    """Removed: similar to a kept record. Kept: compared in all its buckets, and no undecided earlier record is similar."""
    seen = links.join(state.select(F.col("key").alias("a"), "kept"), "a").groupBy(F.col("b").alias("key")).agg(F.max(F.coalesce("kept", F.lit(False))).alias("hit"), F.max(F.col("kept").isNull()).alias("open"))
    ready = members.groupBy("key").agg(F.min("taken").alias("ready"))
    new = F.when(F.coalesce("hit", F.lit(False)), False).when(F.col("ready") & ~F.coalesce("open", F.lit(False)), True)
    return materialize(state.join(ready, "key").join(seen, "key", "left").select("key", F.coalesce("kept", new).alias("kept")))


def _no_pairs(df: DataFrame, key: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame([], f"a {kind}, b {kind}, similarity double")


def keep_first(nodes: DataFrame, pairs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, kept, and for removed rows matched_id and similarity, by the rule above.

    ``pairs``: a, b, similarity in either direction. Each round decides all rows none of whose earlier
    neighbours is undecided, so rounds are as many as the longest chain of dependence.
    """
    rank = nodes.select(F.col(key).alias("k"), F.struct(*order, key).alias("o"))
    ra, rb = (rank.select(F.col("k").alias(x), F.col("o").alias(f"o{x}")) for x in "ab")
    e = pairs.join(ra, "a").join(rb, "b")
    first = F.col("oa") < F.col("ob")
    edges = materialize(e.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), "similarity"))
    state = materialize(edges.select(F.col("u").alias("k")).union(edges.select("v")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not state.filter("kept IS NULL").isEmpty():
        s = edges.join(state.select(F.col("k").alias("u"), F.col("kept").alias("ku")), "u")
        seen = s.groupBy(F.col("v").alias("k")).agg(F.max(F.coalesce(F.col("ku"), F.lit(False)).cast("int")).alias("hit"), F.max(F.col("ku").isNull().cast("int")).alias("open"))
        new = F.when(F.coalesce("hit", F.lit(0)) == 1, F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        old, state = state, materialize(state.join(seen, "k", "left").select("k", F.coalesce("kept", new).alias("kept")))
        discard(old)
    return _matched(nodes, edges, state, rank, key)


def _matched(nodes: DataFrame, edges: DataFrame, state: DataFrame, rank: DataFrame, key: str) -> DataFrame:
    """Decisions (k, kept) with the most similar kept row before each removed one, by edges (u, v, similarity), u first."""
    kept = state.filter("kept").select(F.col("k").alias("u"))
    best = edges.join(kept, "u").join(rank.select(F.col("k").alias("u"), "o"), "u").groupBy(F.col("v").alias("k")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "o", "u")).alias("m"))
    out = nodes.select(F.col(key).alias("k")).join(state, "k", "left").join(best, "k", "left")
    gone = F.col("kept") == F.lit(False)
    return out.select(F.col("k").alias(key), F.coalesce("kept", F.lit(True)).alias("kept"), F.when(gone, F.col("m.u")).alias("matched_id"), F.when(gone, F.round(-F.col("m.s"), 6)).alias("similarity"))


def near(df: DataFrame, key: str, text: str, order: list[str], threshold: float = 0.8, **options) -> DataFrame:
    """Exact duplicates first, then the keep-first rule over similar pairs of what is left."""
    first, copies = exact(df, text, order, key)
    first = materialize(first)
    links, state = settled(first, key, text, order, threshold, **options)
    rank = first.select(F.col(key).alias("k"), F.struct(*order, key).alias("o"))
    found = _matched(first, links.select(F.col("a").alias("u"), F.col("b").alias("v"), "similarity"), state.select(F.col("key").alias("k"), "kept"), rank, key)
    more = copies.select(key, F.lit(False).alias("kept"), F.col("matched_id"), F.lit(1.0).alias("similarity"))
    return found.unionByName(more)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
