"""The corpus operators against brute force, SQL, round trips and held-out accuracy, and on odd inputs."""

import gzip
import hashlib
import random
import re
import string
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from heddle.llm import parity_join, quality_knn, quality_rules, queries, rank_langid, secret_cnn, sentencepiece_codec, source_mix, telephony, token_rollup, warc_revisit
from heddle.llm.shared import shared_dir

ODD = [None, "", " ", "\n", "a", "a  b\t\n\n c ", "é ﬁ 日本 🎉 x▁y", "one two three " * 4000, "same", "same", "\x00\x07"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keys string, at long, k long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, repeated rows, and columns with names the operators use."""
    rows = [(k, t, None if k % 2 else "en", None if k % 3 else "s", None, 0.5, "x", 1, 1) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[8], rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(duck):
    return duck.execute("select doc_id, text from documents order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(name, spark, sf, duck):
    same(queries.QUERIES[name](spark, sf), duck, queries.ORACLE[name])


# ---- 1


def test_pieces_are_the_librarys():
    codec = sentencepiece_codec.Codec(queries.piece_model(), cache=500)
    r = random.Random(1)
    made = ["".join(r.choice(["a", "b", "the", " ", "  ", "\n", ".", "é", "中", "🎉", "ing", "\t", "!", "1", "▁"]) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    many = [t or "" for t in ODD] + made
    for s in range(0, len(many), 100):
        got, bad = codec.encode(many[s : s + 100])
        assert bad == [0] * len(got) and got == [[*i, codec.end] for i in codec.library.encode(many[s : s + 100])]


def test_op1(spark, sf, duck):
    lib = sentencepiece_codec.codec(queries.piece_model()).library
    got = {r.doc_id: r for r in queries.op1_sentencepiece(spark, sf).collect()}
    for k, t in texts(duck):
        ids = [*lib.encode(t or ""), lib.eos_id()]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


def test_long_chunks_and_a_broken_agenda(monkeypatch):
    """A text without blanks takes seconds; ids come from the agenda, so a broken one fails, and a rare fault is counted."""
    codec = sentencepiece_codec.Codec(queries.piece_model())
    r = random.Random(2)
    long = "".join(r.choices("etaoinshrdlu", k=200_000)) + "中" * 1000
    began = time.time()
    got, bad = codec.encode([long, long + " x", None])
    assert got == [[*codec.library.encode(t), codec.end] for t in (long, long + " x", "")] and bad == [0, 0, 0] and time.time() - began < 30
    assert all(len(c) <= sentencepiece_codec.LONGEST for c in codec.known)
    whole = sentencepiece_codec.Codec(queries.piece_model())
    whole.plain = False  # as for a model whose pieces hold blanks inside
    texts = ["a  b c\n d", "", "x" * 300]
    assert whole.encode(texts) == ([[*codec.library.encode(t), codec.end] for t in texts], [0, 0, 0])
    right = codec.agenda
    monkeypatch.setattr(codec, "agenda", lambda chunks: [ids[:-1] if c == "rarely" else ids for c, ids in zip(chunks, right(chunks))])
    words = [f"w{i}" for i in range(150)]
    got, bad = codec.encode(["rarely " + " ".join(words), "rarely rarely", "often"])
    assert bad == [1, 2, 0] and got[1] == [*codec.library.encode("rarely rarely"), codec.end]
    monkeypatch.setattr(codec, "agenda", lambda chunks: [ids[::-1] for ids in right(chunks)])
    with pytest.raises(RuntimeError):
        codec.encode([" ".join(f"other{i}" for i in range(50))])


def test_decoding(spark):
    rows = [("a  b\n é🎉",), (None,), ("",)]
    got = sentencepiece_codec.decode(sentencepiece_codec.encode(spark.createDataFrame(rows, "text string"), queries.piece_model(), ids=True), queries.piece_model()).collect()
    assert [r.decoded_text for r in got] == ["a  b\n é🎉", "", ""]


# ---- 2


def test_rollup_in_the_order_of_commits(spark):
    """Ids of batches need not rise; compaction changes nothing; null ids and versions count; counts may be op1's."""
    kind = "doc_id long, tokenizer_version string, source string, lang string, n_tokens long, op string"
    batch = lambda *rows: spark.createDataFrame([(k, "v", "a", "x", n, op) for k, n, op in rows], kind)
    for every in (2, 100):
        roll = token_rollup.TokenRollup(spark, shared_dir(spark), buckets=4, compact_after=every)
        for number, rows in ((0, [(2, 100, "insert")]), (5, [(1, 10, "insert")]), (3, [(1, 7, "revise")]), (6, [(1, 0, "delete"), (None, 3, "insert")]), (7, [(None, 4, None)])):
            assert roll.commit(number, batch(*rows)) and not roll.commit(number, batch((9, 9, "insert")))
        assert roll.batches() == [0, 5, 3, 6, 7]
        assert [tuple(r) for r in roll.totals().collect()] == [("a", "x", "v", 2, 104)]
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    counted = sentencepiece_codec.encode(docs, queries.piece_model())
    roll = token_rollup.TokenRollup(spark, shared_dir(spark), buckets=4)
    assert roll.commit(0, counted.selectExpr("doc_id", "'piece_bpe_32k' AS tokenizer_version", "'s' AS source", "NULL AS lang", "n_tokens", "'insert' AS op"))
    assert [tuple(r) for r in roll.totals().collect()] == [("s", None, "piece_bpe_32k", 2, 5)]


def test_rollup(spark):
    roll = token_rollup.TokenRollup(spark, shared_dir(spark))
    kind = "doc_id long, tokenizer_version string, source string, lang string, n_tokens long, op string"
    batch = lambda *rows: spark.createDataFrame([(k, "v", s, None, n, op) for k, s, n, op in rows], kind)
    assert roll.commit(0, batch((1, "a", 10, "insert"), (2, "a", 5, "insert"), (3, None, None, "insert")))
    assert roll.commit(1, batch((1, "b", 7, "revise"), (2, "a", 0, "delete"), (9, "a", 3, "delete")))
    assert not roll.commit(1, batch((1, "b", 70, "revise")))
    assert roll.commit(2, batch((2, "a", 4, "insert"), (1, "b", 8, "revise")))
    assert roll.commit(3, spark.createDataFrame([], kind))
    assert {(r.source, r.n_docs, r.n_tokens) for r in roll.totals().collect()} == {("a", 1, 4), ("b", 1, 8), (None, 1, 0)}


# ---- 3


def test_quality_held_out(spark, sf, duck):
    got = {r.doc_id: r for r in queries.op3_quality(spark, "/root/testdata/sf0.01").collect()}
    import duckdb

    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    held = [k for k in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out for k in held) and np.mean([got[k].predicted == labels[k] for k in held]) > 0.93


def test_votes_by_brute_force():
    r = np.random.default_rng(0)
    x = np.abs(r.normal(size=(60, quality_knn.TERMS))).astype(np.float32)
    y = (np.arange(60) % 3 > 0).astype(float)
    m = quality_knn.fit(x, y, rank=8, k=5)
    new = np.abs(r.normal(size=(7, quality_knn.TERMS))).astype(np.float32)
    for s, v in zip(m.score(new), m.embed(new), strict=True):
        near = np.round(m.vectors @ v, 5)
        best = np.argsort(-near, kind="stable")[:5]
        w = np.maximum(near[best], 0).astype(float) ** quality_knn.SHARPNESS
        assert s == pytest.approx((w @ y[best] + 1e-6 * y.mean()) / (w.sum() + 1e-6), abs=1e-3)


def test_voting_without_the_module(spark):
    """Weights, latent space and votes of a small sample, recomputed from the terms alone; the bound of the fit."""
    r = random.Random(3)
    good, bad = "the cat and a dog ran home".split(), "$$ %% !! ## BUY NOW".split()
    texts = [" ".join(r.choices(good if k % 2 else bad, k=30)) for k in range(40)]
    y = np.arange(40) % 2.0
    x = np.array([quality_knn.terms(t) for t in texts])
    model = quality_knn.fit(x, y, rank=6, k=5)
    idf = np.maximum(np.log(41 / (1 + (x > 0).sum(axis=0))), 0.05)
    idf[-quality_knn.REPEATS :] = 1
    u, s, v = np.linalg.svd(x * idf, full_matrices=False)
    new = np.array([quality_knn.terms(" ".join(r.choices(good + bad, k=12))) for _ in range(9)])
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    near = unit(new * idf @ v[:6].T) @ unit(x * idf @ v[:6].T).T
    for score, row in zip(model.score(new), near):
        best = np.argsort(-row)[:5]
        w = np.maximum(row[best], 0) ** 4
        assert score == pytest.approx((w @ y[best]) / w.sum(), abs=2e-3)
    docs = spark.createDataFrame([(k % 2 + 1, f"text {k}") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(quality_knn.learn(docs, labels, per_label=1).labels) <= 2
    assert quality_knn.terms("a b").sum() > 0 and not quality_knn.terms("").any()


# ---- 4


def brute_components(rows, k=3, percent=90):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[x : x + k]) for x in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=3):
    r, rows = random.Random(seed), list(enumerate([None, "", "a", "A", "a b", "a B"]))
    words = [f"w{i}" for i in range(300)]
    for _ in range(25):
        base = r.choices(words, k=r.choice([6, 9, 10, 12, 15, 20, 25, 40, 60, 100, 300]))
        for _ in range(r.choice([1, 3, 8, 25])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // r.choice([10, 20, 40])))):
                at, what = r.randrange(len(w)), r.random()
                if what < 0.6:
                    w[at] = r.choice(words)
                elif what < 0.8:
                    w.insert(at, r.choice(words))
                elif len(w) > 3:
                    del w[at]
            rows.append((len(rows), " ".join(w)))
    return rows


def test_components_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 4)
    rows = near_copies()
    got = parity_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_sketches_bound_the_difference():
    r = np.random.default_rng(1)
    sk = parity_join.Sketcher(90)
    for n in (9, 12, 19, 30, 60, 400):
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[r.integers(0, 2, len(a)) * 0 + (r.random(len(a)) > 0.05).astype(int) == 1], r.integers(0, 2**63, r.integers(0, 3), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            shared = set(sk.bands(len(a))) & set(sk.bands(len(b)))
            linked = 100 * both >= 90 * (len(a) + len(b) - both)
            keys = [set(x[0].tolist()) & set(y[0].tolist()) for q in shared if (x := sk.sketch(a, q)) and (y := sk.sketch(b, q))]
            if linked and both < max(len(a), len(b)):
                assert any(keys)
            for q in shared:
                if (x := sk.sketch(a, q)) and (y := sk.sketch(b, q)):
                    assert parity_join._near(x[1], y[1]) <= len(a) + len(b) - 2 * both


# ---- 5


def test_audio_round_trip(spark, sf, duck):
    got = {r.doc_id: r for r in queries.op5_media(spark, sf).collect()}
    for k, t in texts(duck):
        data = (t or "").encode()
        pay = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        # the file, its law and the doubled rate, written out by the format's rules
        stored = b"RIFF" + (50 + len(pay)).to_bytes(4, "little") + b"WAVEfmt " + struct.pack("<IHHIIHHH", 18, 7, 1, 8000, 8000, 1, 8, 0) + b"fact" + struct.pack("<II", 4, len(pay)) + b"data" + len(pay).to_bytes(4, "little") + pay
        sha = lambda x: hashlib.sha256(x).hexdigest()
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(data), len(pay), sha(pay), zlib.crc32(pay[-64:]), len(stored), sha(stored))
        pcm = [mu_one(b) for b in pay]
        twice = doubled(pcm)
        raw = np.array(twice, "<i2").tobytes()
        assert r.pcm_sha256 == sha(b"RIFF" + (50 + len(raw)).to_bytes(4, "little") + b"WAVEfmt " + struct.pack("<IHHIIHHH", 18, 1, 1, 16000, 32000, 2, 16, 0) + b"fact" + struct.pack("<II", 4, len(twice)) + b"data" + len(raw).to_bytes(4, "little") + raw)
        level = lambda x: sum(map(abs, x)) // len(x)
        parts = dict(p.split(":", 1) for p in r.feature.split(";"))
        assert (parts["mu"], parts["pcm16k"], parts["zero"]) == (str(level(pcm)), f"{level(twice)}:{zlib.crc32(raw):08x}", str(sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))))


def mu_one(b):
    """G.711 mu-law, a byte at a time."""
    b = ~b & 255
    size = ((b & 15) * 8 + 132) * 2 ** (b >> 4 & 7) - 132
    return -size if b & 128 else size


def doubled(pcm):
    at = lambda i: pcm[min(max(i, 0), len(pcm) - 1)]
    out = []
    for i in range(len(pcm)):
        out += [pcm[i], max(-32768, min(32767, (9 * (at(i) + at(i + 1)) - at(i - 1) - at(i + 2) + 8) >> 4))]
    return out


def test_adpcm_encoding():
    """Blocks of a sound decode close to it, and the encoder picks, a sample at a time, the code that the rules give."""
    r = np.random.default_rng(4)
    pcm = (9000 * np.sin(np.arange(1500) / 11) + r.normal(0, 100, 1500)).astype(np.int16)
    blocks = telephony.to_adpcm(pcm, 64)
    back = telephony.adpcm(blocks).ravel()[: len(pcm)].astype(float)
    assert blocks.shape == (13, 64) and 10 * np.log10((pcm.astype(float) ** 2).mean() / ((back - pcm) ** 2).mean()) > 30
    for n, block in enumerate(blocks):
        mine = pcm[n * 121 : (n + 1) * 121].astype(int).tolist()
        value, index = mine[0], int(block[2])
        codes = [c for byte in block[4:].tolist() for c in (byte & 15, byte >> 4)]
        for x, code in zip(mine[1:], codes):
            step, left, want, d = int(telephony.STEP[index]), abs(x - value), 8 * (x < value), int(telephony.STEP[index]) >> 3
            for bit in (4, 2, 1):
                if left >= step:
                    want, left, d = want | bit, left - step, d + step
                step >>= 1
            assert code == want
            value = max(-32768, min(32767, value - d if want & 8 else value + d))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][want & 7]))
    assert telephony.to_adpcm(np.empty(0, np.int16)).shape == (0, 64)


def test_audio_columns(spark):
    """Raw columns of each codec, damaged and missing files."""
    pcm = np.arange(-600, 610, 10).astype(np.int16)
    one = telephony.to_adpcm(pcm, 64).tobytes()
    df = spark.createDataFrame([(bytearray(b"\x00\xff\x2a"), bytearray(one + b"xx")), (None, None), (bytearray(), bytearray())], "raw binary, ad binary")
    get = lambda col, codec: [None if r.pcm is None else np.frombuffer(r.pcm, "<i2").tolist() for r in telephony.decoded(df, col, codec, 64).collect()]
    assert get("raw", "mu") == [[-32124, 0, -5372], None, []] and get("raw", "a")[0] == telephony.A[[0, 255, 42]].tolist()
    assert np.abs(np.array(get("ad", "adpcm")[0]) - pcm).max() < 40 and get("ad", "adpcm")[1:] == [None, []]
    good = telephony.wave(b"abcd" * 16)
    files = spark.createDataFrame([(bytearray(x) if x is not None else None,) for x in (good, good[:-3], b"RIFF", b"", None, telephony.wave(b"ab", 6))], "media binary")
    got = telephony.read_back(files).collect()
    assert [r.payload for r in got] == [b"abcd" * 16, None, None, None, None, None] and [r.pcm_16k is None for r in got] == [False, *[True] * 5]


def test_adpcm_one_by_one():
    data = np.random.default_rng(2).integers(0, 256, (5, 64), dtype=np.uint8)
    for block, got in zip(data, telephony.adpcm(data), strict=True):
        value, index = int(np.frombuffer(block[:2].tobytes(), "<i2")[0]), min(int(block[2]), 88)
        out = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEP[index])
                d = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                out.append(value)
        assert got.tolist() == out


def test_law_tables():
    assert telephony.MU[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.A[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


# ---- 6


def test_grams_by_brute_force():
    for t in [x for x in ODD if x]:
        want = Counter()
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            s = f"_{w}_"
            want.update(x for n in (1, 2, 3) for x in (s[i : i + n] for i in range(len(s) - n + 1)) if x.strip("_"))
        got = rank_langid.grams(t)
        assert sorted(got[1].tolist()) == sorted(want.values())


def test_distance_by_brute_force():
    """Ranks, ties, distance, score and choice of language, from plain counters."""
    r = random.Random(9)

    def ranked(text, size):
        grams = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            s = f"_{w}_"
            grams.update(x for n in (1, 2, 3) for x in (s[i : i + n] for i in range(len(s) - n + 1)) if x.strip("_"))
        code = lambda g: [0 if c == "_" else ord(c) for c in g]
        return sorted(grams, key=lambda g: (-grams[g], len(g), code(g)))[:size]

    made = {k: " ".join("".join(r.choices(letters, k=r.randint(1, 6))) for _ in range(400)) for k, letters in {"x": "abcdeé", "y": "abcxyz", "z": "ßüab"}.items()}
    size = 60
    own = {k: ranked(t, size) for k, t in made.items()}
    model = rank_langid.Model({k: rank_langid.profile(*rank_langid.grams(t), size) for k, t in made.items()}, size)
    for _ in range(200):
        text = " ".join("".join(r.choices("abcdeéxyzßü", k=r.randint(1, 5))) for _ in range(r.randint(1, 30)))
        mine = ranked(text, size)
        far = {k: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(mine)) for k, p in own.items()}
        best = min(sorted(far), key=far.get)
        assert model.predict(text) == (best, pytest.approx(1 - far[best] / (size * len(mine))))
    assert model.predict("12 !") == model.predict(None) == ("und", 0.0)


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = [r for r in queries.op6_language(spark, d).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got]) > 0.95


# ---- 7


def test_mix_comes_near_targets(spark, sf):
    rows = source_mix.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target) and all(r.taken <= 2 * r.size for r in mine)
    again = source_mix.mix(spark.read.parquet(f"{sf}/documents.parquet").repartition(3)).collect()
    assert sorted(rows) == sorted(again)


def test_mixed_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = {r.doc_id: r.taken for r in source_mix.mix(docs).collect()}
    got = Counter()
    for r in source_mix.mixed(docs).collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert {k: v for k, v in plan.items() if v} == dict(got)


def test_mixed_repeats_and_order(spark, sf):
    """Rows that repeat a doc_id, or all columns, are taken as planned; any long stretch of the mix is near the weights."""
    docs = spark.createDataFrame([(1, "a b c", "s", 0), (1, "d e f g h", "s", 0), (2, "x y", "s", 0), (2, "x y", "s", 0), (None, "q", "s", 0), (3, None, "s", 0), (None, "q r", None, 0)], "doc_id long, text string, source string, pass int")
    plan = Counter()
    for r in source_mix.mix(docs, percent=120).collect():
        plan[r.doc_id] += r.taken
    got = Counter()
    for r in source_mix.mixed(docs, percent=120).collect():
        got[r.doc_id] += len(r.text.split())
    assert sum(plan.values()) == sum(got.values()) > 10 and {k: v for k, v in plan.items() if v} == dict(got)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    target = {r.source: r.target for r in source_mix.mix(docs, block=64).select("source", "target").distinct().collect()}
    rows = sorted((r.slot, r.source, r.n) for r in source_mix.mixed(docs, order="slot", block=64).selectExpr("slot", "source", "size(split(text, '[ \n]+')) AS n").collect())
    for part in (rows[: len(rows) // 3], rows[: len(rows) // 2], rows):
        words = Counter()
        for _, s, n in part:
            words[s] += n
        assert all(abs(words[s] / sum(words.values()) - t / sum(target.values())) < 0.03 for s, t in target.items())


def test_schedule_of_many_sources(spark):
    shares = spark.createDataFrame([(k, float(50 + k % 7)) for k in range(1, 3001)], "k int, target double")
    got = source_mix.schedule(shares, block=8).collect()
    words = Counter()
    for r in got:
        words[r.k] += r.words
    assert len({(r.k, r.rank) for r in got}) == len(got) and words == {k: 50 + k % 7 for k in range(1, 3001)}


# ---- 8


def test_warc_records(spark):
    """Records written and parsed again: several a file, gzip members, a body with blank lines, damage at any place."""
    from heddle.llm import warc_records as W

    one = W.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:a>", "WARC-Target-URI": "http://a/", "WARC-Date": "2020-01-02T03:04:05.5Z"}, W.http(200, {"ETag": "x", "Vary": "a", "vary": "b"}, b"body\r\n\r\nmore"))
    two = W.record({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:b>", "WARC-Profile": W.SAME_DIGEST, "WARC-Refers-To-Target-URI": "http://a/", "WARC-Date": "bad"}, b"")
    for data in (one + two, gzip.compress(one) + gzip.compress(two)):
        a, b = map(W.row, W.records(data))
        assert a[:4] == ("urn:a", "http://a/", 1577934245, "response") and a[8:11] == (200, "x", None) and a[11] == {"etag": "x", "vary": "a, b"} and a[12] == b"body\r\n\r\nmore"
        assert b[0] == "urn:b" and b[2] is None and b[4] == W.SAME_DIGEST and b[6] == "http://a/"
    for cut in range(1, len(one) - 4):
        assert [W.row(r)[3] for r in W.records(one[:cut])] == ["damaged"]
    files = spark.createDataFrame([(bytearray(one + two),), (None,), (bytearray(),), (bytearray(one + b"junk"),)], "content binary")
    got = W.parsed(files, payload=True).collect()
    assert [r.kind for r in got] == ["response", "revisit", "response", "damaged"] and bytes(got[0].payload) == b"body\r\n\r\nmore"
    rows = [("r1", "http://a/", 5, "response", 200, {"etag": "q"}, bytearray(b"x\x00")), ("r2", None, None, "revisit", 304, None, None)]
    back = W.parsed(W.written(spark.createDataFrame(rows, "record_id string, url string, ts long, kind string, status int, headers map<string,string>, body binary")), payload=True).collect()
    assert [(r.record_id, r.url, r.ts, r.kind, r.status, r.headers, bytes(r.payload)) for r in back] == [("r1", "http://a/", 5, "response", 200, {"etag": "q"}, b"x\x00"), ("r2", None, None, "revisit", 304, {}, b"")]


def test_revisits_by_brute_force(spark):
    """Hot URLs and equal times, repeated rows, HTTP dates, digests, references, clashing and null columns."""
    from heddle.llm.warc_records import SAME_DIGEST

    r = random.Random(5)
    dates = ["Sun, 06 Nov 1994 08:49:37 GMT", "06 Nov 1994 08:49:37 GMT", "Mon, 07 Nov 1994 08:49:37 GMT", "yesterday", None]
    time_of = {dates[0]: 1, dates[1]: 1, dates[2]: 2}
    rows = []
    for k in range(600):
        url = r.choice(["http://hot.org/a"] * 5 + [f"http://b.org/{r.randrange(20)}", None])
        ts = r.choice([7, 7, 7, *range(60), None])
        kind = r.choice(["response", "revisit", "metadata", None])
        refers = r.choice([None, None, None, "http://hot.org/a#x"]) if kind == "revisit" else None
        rows.append((k, url, ts, kind, r.choice(["a", "W/a", "b", None]), r.choice(dates), None, r.choice([None, SAME_DIGEST]), r.choice(["d", "e", None]), refers, "clash", "clash"))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, profile string, payload_digest string, refers_to_uri string, response_id string, share string")

    def same(v, p):
        if v[7] == SAME_DIGEST:
            return None if v[8] is None or p[8] is None else v[8] == p[8]
        if v[4] and p[4]:
            return v[4].removeprefix("W/") == p[4].removeprefix("W/")
        if v[5] and p[5]:
            return time_of[v[5]] == time_of[p[5]] if v[5] in time_of and p[5] in time_of else v[5] == p[5]

    want = []
    for v in [x for x in rows if x[3] == "revisit"]:
        url = "http://hot.org/a" if v[9] else v[1]
        before = [x for x in rows if x[3] == "response" and url and x[1] == url and v[2] is not None and x[2] is not None and x[2] < v[2]]
        p = max(before, key=lambda x: (x[2], x[0]), default=None)
        s = None if p is None else same(v, p)
        want.append((v[0], p[0] if p else None, "unresolved" if p is None else "unchecked" if s is None else "confirmed" if s else "changed"))
    got = [(x.record_id, x.response_id, x.status) for x in warc_revisit.resolve(df).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_revisits(spark):
    row = lambda i, url, ts, kind, etag=None, lm=None, **h: (i, url, ts, kind, etag, lm, {k.replace("_", "-"): v for k, v in h.items()} or None)
    u = "HTTP://Ex.org:80/a/?utm_source=x#top"
    rows = [
        row(1, u, 10, "response", '"a"', content_type="text", date="1"),
        row(2, "http://ex.org/a", 20, "response", '"b"', content_type="html", date="2"),
        row(3, "http://ex.org/a?ref=z", 10, "revisit", '"a"'),
        row(4, "http://ex.org/a", 15, "revisit", 'W/"a"', date="9", content_length="0"),
        row(5, "http://ex.org/a", 30, "revisit", '"a"'),
        row(6, "http://ex.org/a", 30, "revisit", None, "yesterday"),
        row(7, None, 30, "revisit", '"a"'),
        row(8, "http://ex.org/b", None, "revisit", '"a"'),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    got = {r.record_id: (r.response_id, r.status) for r in warc_revisit.resolve(df).collect()}
    assert got == {3: (None, "unresolved"), 4: (1, "confirmed"), 5: (2, "changed"), 6: (2, "unchecked"), 7: (None, "unresolved"), 8: (None, "unresolved")}
    assert next(r.headers for r in warc_revisit.resolve(df).collect() if r.record_id == 4) == {"content-type": "text", "date": "9"}
    assert warc_revisit.resolve(df.limit(0)).count() == 0


# ---- 9


def test_rules_by_brute_force(spark, odd):
    for r in quality_rules.judge(odd).collect():
        t = ODD[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)


# ---- 10


def test_base_spans():
    key = "AKIA" + "Q" * 12
    t = f"é Token = 'abcdefgh1' {key} {'0a' * 16} password: short secret_token=zzzzzzzz AKIAshort"
    got = [(secret_cnn.KINDS[k], t[a:b]) for a, k, b in secret_cnn.base_spans(t)]
    assert got == [("assign", "Token = 'abcdefgh1"), ("access", key), ("hex", "0a" * 16), ("assign", "token=zzzzzzzz")]
    assert secret_cnn.base_spans("password: token: abcdefgh12") == []
    r = random.Random(4)
    for _ in range(400):
        t = "".join(r.choice(["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " ", ":", "=", "abcdefgh", "0a" * 8, "AKIA", "Q9Z" * 3, "é", "-", "\n"]) for _ in range(r.randint(1, 14)))
        assert secret_cnn.base_spans(t) == independent_base(t), t


def test_network_recall():
    net = secret_cnn.standard_network()
    new = secret_cnn.labelled_findings(600, 77)
    y = np.array([f[3] for f in new])
    p = net.score(np.array([secret_cnn.window(t, a, b) for t, a, b, _ in new])) >= net.threshold
    assert p[y == 1].mean() > 0.93 and p[y == 0].mean() < 0.1


def test_network_by_hand():
    """The forward pass with plain loops, and the gradients by finite differences."""
    net = secret_cnn.standard_network()
    x, y = secret_cnn.labelled_windows(secret_cnn.labelled_findings(6, 77))
    S = secret_cnn
    for row, raw in zip(x, net.raw(x)):
        e = [net.embed[c] for c in row]
        z = np.array([sum(e[i + w] @ net.kernel[w * S.DIM : (w + 1) * S.DIM] for w in range(S.WIDTH)) + net.bias for i in range(S.LENGTH - S.WIDTH + 1)])
        inside = np.array([S.SIDE <= i + S.WIDTH // 2 < S.SIDE + S.INSIDE for i in range(len(z))])
        h = np.concatenate([z[inside].max(axis=0), z[~inside].max(axis=0), z[inside].mean(axis=0)])
        assert raw == pytest.approx(float(np.maximum(h, 0) @ net.out + net.out_bias))
    _, grads = net.gradients(x, y)
    for name, grad, at in (("embed", grads[0], (int(x[0, 30]), 3)), ("kernel", grads[1], (7, 5)), ("bias", grads[2], (2,)), ("out", grads[3], (9,))):
        value, old = getattr(net, name), getattr(net, name)[at]
        losses = []
        for step in (1e-5, -1e-5):
            value[at] = old + step
            losses.append(net.gradients(x, y)[0])
        value[at] = old
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grad[at], abs=1e-7)


def independent_base(text):
    """Base findings by scanning each character, without the module's patterns."""
    word, out = set(string.ascii_letters + string.digits + "+/_.=-"), []
    low, n = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text), len(text)
    at = 0
    while at < n:
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(name, at):
                continue
            p = at + len(name)
            p += text[p : p + 1] in ('"', "'") and p < n
            while text[p : p + 1] == " ":
                p += 1
            if text[p : p + 1] not in (":", "=") or p >= n:
                continue
            p += 1
            while text[p : p + 1] == " ":
                p += 1
            p += text[p : p + 1] in ('"', "'") and p < n
            end = p
            while end < n and text[end] in word:
                end += 1
            if end > p:
                if end - p >= 8:
                    out.append((at, 0, end))
                at = end - 1
                break
        at += 1
    for kind, lead, chars, least in ((1, "AKIA", string.ascii_uppercase + string.digits, 16), (2, "", "0123456789abcdef", 32)):
        at = 0
        while at < n:
            end = at + len(lead)
            if text.startswith(lead, at):
                while end < n and text[end] in chars:
                    end += 1
            if text.startswith(lead, at) and end > at + len(lead):
                if end - at >= least:
                    out.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(out)


def test_planted_secrets_of_documents(spark, duck):
    """Precision and recall of the network on the tables' own secrets, which it was not trained on."""
    import duckdb

    many = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchall()]
    net = secret_cnn.standard_network()
    found = secret_cnn.weighed(many, net)
    base = [x for spans in found for x in spans if x[1] < 3]
    runs = sum(len(secret_cnn.clear(secret_cnn.candidates(t), secret_cnn.base_spans(t))) for t in many)
    assert np.mean([p >= net.threshold for *_, p in base]) > 0.9
    assert sum(x[1] == 3 for spans in found for x in spans) < 0.05 * runs


def found_share(keys, before="see ", after=" and so on"):
    got = secret_cnn.find([before + k + after for k in keys], secret_cnn.standard_network())
    return np.mean([any(a < len(before) + len(k) and b > len(before) for a, _, b in spans) for k, spans in zip(keys, got, strict=True)])


def test_keys_of_few_digits_and_one_case():
    """Through find(): no rule before the network drops a key, and it rejects words."""
    rng = random.Random(5)
    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    keys = lambda chars, n: ["".join(rng.choices(chars, k=n)) for _ in range(400)]
    assert found_share(keys(low + up + digits, 16)) > 0.85 and found_share(keys(low + digits, 20)) > 0.85
    assert found_share([k for k in keys(low + up + digits, 24) if sum(map(str.isdigit, k)) < 2]) > 0.85
    assert found_share(["internationalization", "well-known-and-often-used", "unverantwortlicherweise", "=" * 40]) == 0


def test_key_inside_a_long_run():
    """Windows over a long candidate leave no character out, so a key between two paths is found."""
    rng = random.Random(6)
    for n in (16, 39, 40, 41, 60, 61, 100, 257):
        at = secret_cnn.places(7, 7 + n)
        assert {k for s in at for k in range(s, s + 40)} >= set(range(7, 7 + n)) and (n < 40 or at[-1] + 40 == 7 + n)
        assert secret_cnn.windows("x" * (14 + n), 7, 7 + n).shape == (len(at), secret_cnn.LENGTH)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=5))
    path = lambda: "/".join(word() for _ in range(6))
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=36)) for _ in range(200)]
    assert found_share(keys, f"see {path()}/", f"/{path()} and") > 0.95
    assert np.mean([bool(s) for s in secret_cnn.find([f"see {path()}/{path()}/{path()} and" for _ in range(200)], secret_cnn.standard_network())]) < 0.05


def test_op10_and_redaction(spark, sf, duck):
    got = {r.doc_id: r for r in queries.op10_secrets(spark, sf).collect()}
    for k, t in texts(duck):
        spans = independent_base(t or "")
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(s[1] == c for s in spans) for c in range(3)]
        assert got[k].base_sha256 == hashlib.sha256(secret_cnn.named(spans).encode()).hexdigest()
    clean = secret_cnn.redact(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert not any(secret_cnn.base_spans(r.text) for r in clean)


# ---- odd and empty tables, the pipeline


def apply_all(df, labels):
    yield sentencepiece_codec.encode(df, queries.piece_model())
    yield quality_knn.score(df, quality_knn.learn(df, labels))
    yield parity_join.link_components(df)
    yield telephony.digests(telephony.read_back(telephony.store(df)))
    yield secret_cnn.redact(df)
    yield rank_langid.predict(df, rank_langid.learn(df))
    yield source_mix.mix(df)
    yield quality_rules.judge(df)
    yield secret_cnn.scan(df)


def test_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, None), (None, None, None)], "doc_id long, quality int, toxic int")
    for df, n in ((odd, odd.count()), (none, 0)):
        for out in apply_all(df, labels):
            assert out.count() == n


def test_odd_values(spark, odd):
    und = {r.doc_id: r.lang_pred for r in rank_langid.predict(odd, rank_langid.learn(odd)).collect()}
    assert [und[k] for k in (0, 1, 2, 3, 10)] == ["und"] * 5
    comp = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.link_components(odd).collect()}
    assert comp[0] == (0, 0) and comp[8] == comp[9] == (1, 8)
    taken = source_mix.mix(odd).collect()
    assert sum(r.taken for r in taken) == sum(int(r.target) for r in {(r.source, r.target): r for r in taken}.values())


def test_odd_stages(spark, odd, none, tmp_path):
    """Every pipeline stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, ids = str(tmp_path), lambda df: sorted(r.doc_id for r in df.collect())
    everyone = sorted([*range(len(ODD)), 8, 0])
    good = P.keep_good(spark, odd, d)
    assert good.columns == odd.columns and ids(good) == everyone and {r.score for r in good.collect()} == {0.5}  # no labels: nothing is rejected
    one = P.keep_one_of_each_group(spark, odd, d)
    assert one.columns == odd.columns and ids(one) == [k for k in everyone if k != 9]
    clean = P.redact_secrets(spark, odd, d)
    assert clean.columns == odd.columns and {(r.doc_id, r.text, r.n_chars) for r in clean.collect()} == {(k, t, None if t is None else len(t)) for k, t in enumerate(ODD)}
    mixed = P.mix_sources(spark, odd, d)
    plan = Counter()
    for r in source_mix.mix(odd).collect():
        plan[r.doc_id] += r.taken
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert mixed.columns == odd.columns and {k: n for k, n in plan.items() if n} == dict(words)
    lib = sentencepiece_codec.codec(queries.piece_model()).library
    coded = P.encode(spark, odd, d).collect()
    assert all(list(r.piece_ids) == [*lib.encode(ODD[r.doc_id] or ""), lib.eos_id()] and r.n_tokens == len(r.piece_ids) for r in coded) and len(coded) == len(everyone)
    for _, stage in P.STAGES:
        assert stage(spark, none, d).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, sf)
    scores = {r.doc_id: r.predicted for r in queries.op3_quality(spark, sf).collect()}
    kept = good.select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in kept) == sorted(k for k, p in scores.items() if p)
    one = corpus_pipeline.keep_one_of_each_group(spark, good, sf).select("doc_id").collect()
    assert sorted(r.doc_id for r in one) == sorted(k for k, (_, c) in brute_components([(r.doc_id, r.text) for r in kept]).items() if k == c)
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns) and {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in one}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "secret_scans", "source_mix", "sentencepiece"]


def test_revisits_of_one_response(spark):
    """Very many revisits of one response, and many of none, all come back once."""
    from heddle.llm import warc_revisit

    kinds = "CASE WHEN id = 0 THEN 'response' ELSE 'revisit' END AS kind"
    log = spark.range(1000).selectExpr("id AS record_id", "IF(id < 600, 'http://a.org/x', concat('http://b.org/', id)) AS url", "id AS ts", kinds, "'t' AS etag", "CAST(NULL AS string) AS last_modified", "map('date', CAST(id AS string)) AS headers")
    rows = warc_revisit.resolve(log).select("record_id", "response_id", "status").collect()
    want = {(k, 0 if k < 600 else None, "confirmed" if k < 600 else "unresolved") for k in range(1, 1000)}
    assert len(rows) == 999 and {tuple(r) for r in rows} == want


def test_candidates_beside_base_findings():
    rng = random.Random(8)
    for _ in range(300):
        base = sorted((a, rng.randrange(3), a + rng.randint(1, 9)) for a in (rng.randrange(80) for _ in range(rng.randrange(8))))
        ends = sorted(rng.sample(range(90), 10))
        spans = list(zip(ends[::2], ends[1::2], strict=True))
        want = [(a, b) for a, b in spans if not any(s < b and a < e for s, _, e in base)]
        assert secret_cnn.clear(spans, base) == want
