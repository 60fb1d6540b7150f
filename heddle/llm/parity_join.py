"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles as 64-bit hashes. Its parity sketch XORs one bit per
shingle, so the Hamming distance of two sketches is at most the size of the sets' symmetric difference.
Two sets with Jaccard >= p/100 differ in at most ``d = (|A|+|B|) (100-p) / (100+p)`` shingles. Sets are
banded by size; in a band every sketch has ``d + t`` parts, at least ``t`` of which must be equal for
such a pair (pigeonhole), so each choice of t parts is a join key. Short sets take larger t, as their
parts say little.

1. Equal sets form classes (by a 64-bit fingerprint of the sorted set).
2. Within a key every class is compared with the least one of the key only: sketches first, the sets
   themselves for what passes. That links nearly all of a group with as many pairs as members.
3. Keys whose members are not yet one component are compared in blocks by sketches, each member with
   its nearest member of another component; what passes is verified; then again with all members
   of other components. Pairs inside one component need no test, so groups of copies cost no square.
4. Components by alternating large-star and small-star steps over links, on written tables.

Null texts, and texts without words, have empty sets and no links. Repeated rows and equal texts share
a class, so do equal texts of null doc_ids. Very long texts are one set each. Extra columns are ignored; an empty table
gives an empty result. Written tables that the result does not read are deleted as soon as they are used.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, materialize, pieces

#: Growth of the size bands.
GROWTH = 1.3
#: The map of wanted documents has 8 bits for each of them, a power of two between these (64 KB to 16 MB).
LEAST_BITS, MOST_BITS = 1 << 19, 1 << 27
#: Bits of the map that one row of its table holds.
STRIP = 1 << 16
#: Members in a block when keys are compared in blocks: a task reads two blocks at a time.
BLOCK = 256
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; one of all words where there are fewer."""
    import xxhash

    words = text.encode().lower().split() if text else []  # of ASCII only, both
    n = len(words)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, n)
    m = max(1, n - k + 1)
    s = np.full(m, min(n, k), U)
    for i in range(min(n, k)):
        s = s * U(0x9E3779B97F4A7C15) + _mix(h[i : i + m])
    return np.unique(_mix(s))


def bands(most: int = 1 << 40) -> list[int]:
    """Lower ends of the size bands."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


def parts_of(d: int) -> tuple[int, int]:
    """Parts of a sketch and how many of them a key takes, for sets that differ in d shingles at most."""
    t = 1
    while d <= 3 and t < 3 and comb(d + t + 1, t + 1) <= 10:
        t += 1
    return d + t, t


class Sketcher:
    """Keys and sketches of sets for pairs with 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = np.array(bands())

    def differ(self, total: int | np.ndarray) -> int | np.ndarray:
        """The largest symmetric difference of two sets with so many elements together."""
        return total * (100 - self.percent) // (100 + self.percent)

    def bands(self, n: int) -> range:
        """The bands in which a set of n is compared: those of all larger partners, its own first."""
        at = lambda x: int(np.searchsorted(self.low, x, "right")) - 1
        return range(at(n), at(n * 100 // self.percent) + 1)

    def sketch(self, s: np.ndarray, band: int) -> tuple[list[int], bytes] | None:
        d = int(self.differ(2 * (int(self.low[band + 1]) - 1)))
        if not d:
            return None  # only equal sets can be this similar
        p, t = parts_of(d)
        v = np.zeros(p, U)
        np.bitwise_xor.at(v, ((s >> U(32)) * U(p) >> U(32)).astype(np.intp), U(1) << (s & U(63)))
        if t == 1:
            key = _mix(_mix(v + U(1)) + np.arange(p, dtype=U) * U(0x9E3779B97F4A7C15) + U(band << 40))
        else:
            pick = np.array(list(combinations(range(p), t)))
            key = np.full(len(pick), band << 40, U) + np.arange(len(pick), dtype=U)
            for c in range(t):
                key = _mix(key + v[pick[:, c]])
        v ^= v >> U(32)
        v ^= v >> U(16)
        return ((key & ~U(0xFF)) | U(band)).view(np.int64), v.astype(np.uint16).tobytes()


def sketch_table(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """doc_id, n (size of the set), fp (its fingerprint), keys, and a sketch for each band it is compared in."""
    schema = T.StructType(
        [docs.schema[doc_id], T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
        + [T.StructField("bands", T.ArrayType(T.IntegerType())), T.StructField("sketches", T.ArrayType(T.BinaryType()))]
    )

    def run(batches):
        import xxhash

        sk = Sketcher(percent)
        for batch in batches:
            for part in pieces(batch, 512, text):
                n, fp, keys, ends, band, sketches = [], [], [np.empty(0, np.int64)], [0], [], []
                for t in part.column(text).to_pylist():
                    s = shingles(t, k)
                    n.append(len(s))
                    fp.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                    got = [(b, x) for b in sk.bands(len(s)) if (x := sk.sketch(s, b))] if len(s) else []
                    keys += [x[0] for _, x in got]
                    ends.append(ends[-1] + sum(len(x[0]) for _, x in got))
                    band.append([b for b, _ in got])
                    sketches.append([x[1] for _, x in got])
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), flat, pa.array(band, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.binary()))], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _set_table(docs: DataFrame, doc_id: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """fp and set of the documents in ``wanted`` (fp, rep), a written table. A bit map keeps most others out early.

    The map grows with the number wanted up to MOST_BITS; beyond some 1e8 wanted documents it lets more others
    through, whose sets the join then drops.
    """
    spark = docs.sparkSession
    size = LEAST_BITS
    while size < min(MOST_BITS, 8 * wanted.count()):
        size *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    at = wanted.select(place(F.col("rep")).alias("at"))
    words = at.selectExpr("shiftright(at, 6) AS w", "shiftleft(1L, int(at % 64)) AS b").groupBy("w").agg(F.expr("bit_or(b)").alias("b"))

    def strip(t: pa.Table) -> pa.Table:
        bits = np.zeros(STRIP // 64, np.int64)
        bits[t.column("w").to_numpy() % len(bits)] = t.column("b").to_numpy()
        return pa.table({"strip": t.column("strip")[:1], "bits": [bits.tobytes()]})

    strips = words.withColumn("strip", F.expr(f"w div {STRIP // 64}")).groupBy("strip").applyInArrow(strip, "strip long, bits binary").collect()  # MOST_BITS / STRIP rows at most
    bits = np.zeros((size // STRIP, STRIP // 64), np.int64)
    for r in strips:
        bits[r.strip] = np.frombuffer(r.bits, np.int64)
    held = spark.sparkContext.broadcast(bits.ravel())
    schema = T.StructType([docs.schema[doc_id], T.StructField("fp", T.LongType()), T.StructField("set", T.BinaryType())])

    def run(batches):
        import xxhash

        for batch in batches:
            p = batch.column("_at").to_numpy()
            batch = batch.filter(pa.array(((held.value[p >> 6] >> (p & 63)) & 1).astype(bool)))
            for part in pieces(batch, 512, text):
                sets = [shingles(t, k) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=schema.names)

    sets = docs.select(doc_id, text, place(F.col(doc_id)).alias("_at")).mapInArrow(run, schema)
    return sets.join(wanted.select("fp", F.col("rep").alias(doc_id)), [doc_id, "fp"]).select("fp", "set")


def _near(a: bytes, b: bytes) -> int:
    return int(np.bitwise_count(np.frombuffer(a, np.uint16) ^ np.frombuffer(b, np.uint16)).sum())


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, band) whose sketches allow the similarity: a, b."""
    side = lambda x: sketches.select(F.col("fp").alias(x), "band", F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def run(batches):
        sk = Sketcher(percent)
        for t in batches:
            na, nb = (t.column(c).to_numpy() for c in ("na", "nb"))
            ok = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent
            most = sk.differ(na + nb)
            sa, sb = t.column("sa"), t.column("sb")
            for k in np.flatnonzero(ok).tolist():
                ok[k] = _near(sa[k].as_py(), sb[k].as_py()) <= most[k]
            yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    return pairs.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"]).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, percent: int, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough: a, b."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(classes, "fp"))
    sets = materialize(_set_table(docs, doc_id, text, k, wanted))

    def run(batches):
        for t in batches:
            a, b = (t.column(c) for c in ("sa", "sb"))
            ok = np.zeros(t.num_rows, bool)
            for i in range(t.num_rows):
                x, y = (np.frombuffer(s[i].as_py(), U) for s in (a, b))
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    side = lambda x: sets.select(F.col("fp").alias(x), F.col("set").alias(f"s{x}"))
    out = materialize(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct())
    discard(sets, wanted)
    return out


def _blocks(members: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Pairs (a, b) of one key and of different components that sketches allow.

    ``members``: key, i, j (the two blocks compared), blk, fp, comp, n, sketch. Of each member only the
    nearest such partner of a block, or all of them. Rows come sorted by key, i and j, and stay in order.
    """

    def compare(sk, fp, comp, n, blk, i, j, raw):
        one = np.flatnonzero(blk == i)
        two = one if i == j else np.flatnonzero(blk == j)
        width = len(raw[0]) // 2
        s = np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), width)
        pad = -width % 4
        s = np.pad(s, ((0, 0), (0, pad))).view(U) if pad else np.ascontiguousarray(s).view(U)
        for x in one.tolist():
            y = two[(comp[two] != comp[x]) & (np.minimum(n[two], n[x]) * 100 >= np.maximum(n[two], n[x]) * percent)]
            if i == j and all_pairs:
                y = y[y > x]
            if len(y):
                far = np.bitwise_count(s[y] ^ s[x]).sum(axis=1)
                y, far = y[ok := far <= sk.differ(n[y] + n[x])], far[ok]
                if len(y) and not all_pairs:
                    y = y[[far.argmin()]]
                for z in y.tolist():
                    yield (fp[x], fp[z]) if fp[x] < fp[z] else (fp[z], fp[x])

    def run(batches):
        sk = Sketcher(percent)
        held = None
        for batch in (*batches, None):
            whole = pa.Table.from_batches([b for b in (held, batch) if b is not None]) if held is not None or batch is not None else None
            if whole is None or not whole.num_rows:
                continue
            t = whole.combine_chunks().to_batches()[0]
            key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            ends = [0, *cuts.tolist(), *([len(key)] if batch is None else [])]
            held = t.slice(ends[-1]) if batch is not None else None
            fp, comp, n, blk = (t.column(c).to_numpy() for c in ("fp", "comp", "n", "blk"))
            raw = t.column("sketch")
            out = []
            for a, b in zip(ends, ends[1:]):
                if b - a > 1:
                    out += compare(sk, fp[a:b], comp[a:b], n[a:b], blk[a:b], i[a], j[a], raw.slice(a, b - a).to_pylist())
            out = sorted(set(out))
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, comp (its component's least node) of links a, b, by alternating star steps until nothing changes.

    Each step writes a table of at most as many links as before; no driver holds links or labels.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        # large star: a node's larger neighbours move to its least neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours and itself move to its least neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, edges = edges, materialize(small.distinct())
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node").union(edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("comp")))


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links, itself included) of every row.

    Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of k-word shingles. All links
    between different texts count; the classes of equal sets and the components are exact but for 64-bit
    hash collisions.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    args = ("doc_id", "text", k, percent)
    table = materialize(sketch_table(base, *args))
    classes = table.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    rows = table.select(F.explode("keys").alias("key"), "fp")
    shared = rows.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("key", "lo")
    members = materialize(rows.join(shared, "key").select("key", "lo", "fp").distinct())
    sketches = table.select("fp", "n", F.explode(F.arrays_zip("bands", "sketches")).alias("x")).select("fp", "n", F.col("x.bands").alias("band"), F.col("x.sketches").alias("sketch")).groupBy("fp", "band").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    check = lambda pairs: _verified(pairs, base, "doc_id", "text", k, percent, classes)
    pairs = members.filter("fp <> lo").select(F.col("lo").alias("a"), F.col("fp").alias("b"), F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("band")).distinct()
    tested = materialize(_sketched(pairs, sketches, percent).distinct())
    links = check(tested)
    done, comp = [members, tested, links], materialize(components(links))
    for all_pairs in (False, True):
        left = members.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("comp", "fp").alias("comp"))
        left = materialize(left.join(left.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).filter("x < y").select("key", "size"), "key"))
        done.append(left)
        if left.isEmpty():
            break
        dealt = left.withColumns({"band": F.col("key").bitwiseAND(F.lit(255)).cast("int"), "of": F.ceil(F.col("size") / BLOCK).cast("int")})
        dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("of")).cast("int")).join(sketches, ["fp", "band"])
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).withColumns({"i": F.least("blk", "o"), "j": F.greatest("blk", "o")})
        new = materialize(_blocks(dealt.select("key", "i", "j", "blk", "fp", "comp", "n", "sketch"), percent, all_pairs).join(tested, ["a", "b"], "left_anti"))
        done.append(new)
        if not new.isEmpty():
            more = check(new)
            done.append(more)
            tested, links = tested.union(new), links.union(more)
            if not more.isEmpty():
                done.append(comp)
                comp = materialize(components(links))
    discard(*done)
    known = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp"))
    least = known.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = known.join(least, "comp").select("fp", "component_id")
    return table.select("doc_id", "n", "fp").join(named, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
