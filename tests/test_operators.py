"""Operators against their definitions on small inputs."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heddle.functions import messages as M
from heddle.functions import text as X
from heddle.functions import vectors as V
from heddle.operators import dedup, geometric, kernel, lexical, sampling, selection
from heddle.plans import catalogue, pool
from heddle.sources import adapters, extract


def test_clean(spark):
    df = spark.createDataFrame([("  a\r\nb\rc\x00ﬁ \t",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.clean(F.col("t"))).collect()] == ["a\nb\ncfi", "", ""]


MESSAGES = [
    ([], "empty_messages"),
    ([("robot", "a")], "invalid_role"),
    ([("user", None)], "content_not_string"),
    ([("assistant", "a")], "first_non_system_not_user"),
    ([("user", "a")], "last_role_not_assistant"),
    ([("system", "s"), ("user", "a"), ("assistant", "b")], None),
    ([("user", "a"), ("system", "s"), ("assistant", "b")], "system_not_at_prefix"),
    ([("user", "a"), ("assistant", " ")], "empty_assistant"),
    ([("user", "a"), ("assistant", "b"), ("assistant", "c")], "assistant_not_alternating"),
    ([("user", "a"), ("user", "b"), ("assistant", "c")], "user_not_alternating"),
    ([("user", "a"), ("tool", "t"), ("assistant", "c")], None),
    ([("user", "a"), ("assistant", "b"), ("tool", "t"), ("assistant", "c")], None),
    ([("user", ""), ("assistant", "b")], None),
]


def test_invalid_reason(spark):
    df = spark.createDataFrame([(k, m) for k, (m, _) in enumerate(MESSAGES)], "k int, m array<struct<role:string,content:string>>")
    got = [r[0] for r in df.orderBy("k").select(M.invalid_reason(F.col("m"))).collect()]
    assert got == [r for _, r in MESSAGES]


@settings(deadline=None, max_examples=200)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 3000), min_size=1, max_size=8), st.floats(0.3, 1))
def test_quotas(counts, share):
    target = max(int(sum(counts.values()) * share), sum(min(n, 5) for n in counts.values()))
    q = sampling.source_quotas(counts, target, base=5)
    assert sum(q.values()) == target and all(0 < q[s] <= counts[s] for s in q)


def test_quota_errors():
    with pytest.raises(ValueError):
        sampling.source_quotas({"a": 1}, 2)
    with pytest.raises(ValueError):
        sampling.source_quotas({"a": 600, "b": 600}, 700)


def test_groups():
    rows = sampling.draws(100, 3, 10, 123)
    assert [p for g, _, p in rows if g == 1] == random.Random(124).sample(range(100), 10) and [r for g, r, _ in rows if g == 2] == list(range(10))
    deck = list(range(100))
    random.Random(123).shuffle(deck)
    assert [p for _, _, p in sampling.draws(100, 3, 10, 123, disjoint=True)] == deck[:30]
    for bad in ((9, 1, 10), (10, 0, 1), (10, 1, 0)):
        with pytest.raises(ValueError):
            sampling.draws(*bad, 1)
    with pytest.raises(ValueError):
        sampling.draws(20, 3, 10, 1, disjoint=True)
    ks = sampling.class_schedule(50, 100, 12, 46)
    assert len(ks) == 12 and sorted(k * 12 // 51 for k in [x - 50 for x in ks]) == sorted(range(12)) or all(50 <= k <= 100 for k in ks)
    assert sampling.reservoir(5, 9, 1) == list(range(5)) and len(set(sampling.reservoir(1000, 10, 42))) == 10


def test_quotas_of_many_tables():
    """Sums, bounds, and the level of the water: no source that is not full stands lower than the others allow."""
    r = random.Random(3)
    for _ in range(300):
        counts = {r.choice("abcdefghij") + str(k): r.randint(0, 900) for k in range(r.randint(1, 9))} | ({None: 7} if r.random() < 0.3 else {})
        counts = {k: n for k, n in counts.items() if n} or {"a": 5}
        base = r.randint(0, 5)
        least, most = sum(min(n, base) for n in counts.values()), sum(counts.values())
        target = r.randint(least, most)
        q = sampling.source_quotas(counts, target, base)
        assert sum(q.values()) == target and all(min(counts[s], base) <= q[s] <= counts[s] for s in q)
        level = lambda s: (q[s] - min(counts[s], base)) / max(1e-9, (counts[s] - min(counts[s], base)) ** 0.5)  # noqa: E731, B023
        free = [s for s in q if q[s] < counts[s]]
        for s in free:
            width = (counts[s] - min(counts[s], base)) ** 0.5
            assert all(level(t) <= level(s) + 1 / width + 1 / max(1e-9, (counts[t] - min(counts[t], base)) ** 0.5) + 1e-9 for t in q if counts[t] > base)
    assert sampling.source_quotas({"source_a": 1000, "source_b": 1000, "coig_cqia": 100}, 1500) == {"coig_cqia": 100, "source_a": 700, "source_b": 700}


def test_rows_without_key_source_or_vector(spark):
    """Null keys are kept or removed, never lost; null sources have quotas; null vectors and empty tables have defined scores."""
    rows = [(None, "t", "s"), (None, "u", None), (1, "t", "s"), (1, "t", "s"), (2, None, "s"), (3, "", "s")]
    kept, gone = dedup.exact(spark.createDataFrame(rows, "id long, text string, source string"), "text", ["source"], "id")
    assert sorted(str(r.text) for r in kept.collect()) == ["None", "t", "u"] and sorted(str((r.id, r.matched_id)) for r in gone.collect()) == ["(1, None)", "(1, None)", "(3, 2)"]
    df = spark.createDataFrame([(k, None if k % 2 else "a") for k in range(20)], "id long, source string")
    got = sampling.quota_sample(df, {"a": 3, None: 4, "zz": 5}, "id").collect()
    assert sum(r.source is None for r in got) == 4 and len(got) == 7
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0, 0.0]), ("d", [0.0, 1.0]), ("e", [1.0, 0.0])], "key string, embedding array<double>")
    assert geometric.distsum_cosine(vec)[0] == pytest.approx(6) and kernel.internal_diversity(vec) == pytest.approx(1 - 10 / 16)
    near = {(r.key, r.other) for r in geometric.nearest(vec, "key").collect()}
    assert near == {("a", "c"), ("c", "a"), ("d", "a"), ("e", "a")}
    none = vec.limit(0)
    assert geometric.distsum_cosine(none) == (0.0, 0.0) and kernel.vendi_dual(none) == 0 and geometric.logdet(none) == 0 and kernel.internal_diversity(none) == 0
    assert geometric.nearest(none, "key").count() == 0


def test_small_tables_of_any_size(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    small = spark.range(7).selectExpr("id AS k", "id * 10 AS v")
    for most in (10, 2):
        assert sorted((r.id, r.v) for r in V.with_small(df, small, "k", most).collect()) == [(i, i % 7 * 10) for i in range(100)]


def sequential(order, links):
    kept = set()
    for x in order:
        if not any((x, y) in links or (y, x) in links for y in kept):
            kept.add(x)
    return kept


def test_keep_first(spark):
    r = random.Random(4)
    links = {(a, b) for a in range(40) for b in range(a + 1, 40) if r.random() < 0.08}
    nodes = spark.createDataFrame([(k, k * 7 % 40) for k in range(40)], "k long, o long")
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in links], "a long, b long, similarity double")
    got = dedup.keep_first(nodes, pairs, "k", ["o"]).collect()
    kept = {x.k for x in got if x.kept}
    assert kept == sequential(sorted(range(40), key=lambda k: k * 7 % 40), links)
    assert all(x.matched_id in kept for x in got if not x.kept)


def test_near_duplicates_keep_the_verified(spark):
    rows = [(1, 1, "abcdefghij"), (2, 0, "abcdefghiX"), (3, 0, "something else"), (4, 0, "something else"), (5, 0, "ab"), (6, 0, "cd"), (7, 0, None)]
    got = {r.k: r for r in dedup.near(spark.createDataFrame(rows, "k long, p int, t string"), "k", "t", ["p"], 0.7).collect()}
    assert not got[1].kept and got[1].matched_id == 2 and got[1].similarity == round(5 / 7, 6)
    assert got[3].kept and got[4].matched_id == 3
    assert [got[k].kept for k in (5, 6, 7)] == [True, False, False]  # texts below the window count as alike


def test_permuted_hashes():
    a, b = dedup.permutations(256, 42)
    assert a[:3].tolist() == [2297359619001564596, 1396682528897996047, 1973689801170867272]
    x = np.array([273373140, 4294967295, 0], np.uint64)
    assert dedup._times(a[:, None], x[None]).tolist() == [[int(v) * int(w) % dedup.PRIME for w in x] for v in a]


def test_kernel_goldens():
    assert kernel.vendi_of([0, 0, 10, 10, 20, 20], lambda a, b: math.exp(-abs(a - b))) == pytest.approx(2.9999, abs=1e-4)
    assert kernel.vendi(np.array([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1]])) == pytest.approx(2.1573, abs=1e-4)
    p = np.array([0.5, 0.5])
    assert kernel.mauve(p, p) == pytest.approx(1, abs=1e-3) and kernel.kl(p, np.array([1.0, 0])) == math.inf


def test_vendi_dual(spark):
    x = np.random.default_rng(0).normal(size=(30, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    assert kernel.vendi_dual(df) == pytest.approx(kernel.vendi(u @ u.T))
    assert geometric.logdet(df, ridge=0.1) == pytest.approx(np.linalg.slogdet(u @ u.T + 0.1 * np.eye(30))[1])
    assert selection.k_center(df, 6) == selection.k_center_kernel(x, 6)


def test_entropy_of_words(spark):
    df = spark.createDataFrame([("Hello",), ("Hello World",), ("World Hi",)], "t string")
    got = lexical.entropy(df, X.words(F.col("t")), 1).first()
    assert got.entropy == pytest.approx(-(4 / 5 * math.log2(2 / 5) + 1 / 5 * math.log2(1 / 5))) and got.total == 5


def test_expected_ttr(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a " * 40), (3, "")], "k int, t string")
    got = {r.k: r.ttr for r in lexical.expected_ttr(df, X.words(F.col("t")), "k").collect()}
    assert got[1] == 1 and got[2] == pytest.approx(1 / 30) and got[3] is None


def test_selection_kernels():
    x = np.eye(4)[[0, 0, 1, 2, 3]]
    assert selection.facility_location(x, 4) == [0, 2, 3, 4]
    assert selection.novelty(x, 2, np.ones(5))[1] in (2, 3, 4)
    assert selection.expected_quality([0.0] * 6) == 3.5 and selection.expected_quality([None] * 6) == 3.0


def vectors_and_table(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(6, 5))[rng.integers(0, 6, n)] + rng.normal(0, 0.3, (n, 5))
    return x, spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("block", [4, 512])
def test_facility_rows(spark, block):
    """Over all rows of a table as the kernel over the matrix, with gains made anew and without."""
    x, df = vectors_and_table(spark, 60, 8)
    assert selection.facility_rows(df, 11, block=block, weighed=5, every=3) == selection.facility_location(x, 11)


def test_facility_query_takes_a_tenth_of_all_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = (u @ u[selection.facility_location(x, len(x) // 10)].T).max(axis=1)
    got = catalogue.QUERIES["facility_location"](spark, sf).first()
    assert got.coverage == pytest.approx(best.sum(), abs=1e-4) and got.mean_coverage == pytest.approx(best.mean(), abs=1e-6)


def test_novelty_rows(spark, sf):
    """Over all rows of a table as the kernel over the matrix, and the query with densities of ten neighbours."""
    x, df = vectors_and_table(spark, 60, 9)
    rho = np.random.default_rng(1).uniform(0.2, 3, 60)
    dense = spark.createDataFrame([(k, float(v)) for k, v in enumerate(rho)], "vec_id long, rho double")
    assert selection.novelty_rows(df, 11, dense, every=3) == selection.novelty(x, 11, rho)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    sq = np.sort(((x[:, None] - x[None]) ** 2).sum(axis=2) + np.diag([np.inf] * len(x)), axis=1)[:, :10]
    want = selection.novelty(x, 4, 1 / np.sqrt(sq.mean(axis=1) + 1e-9))
    got = catalogue.QUERIES["novelty_selection"](spark, sf).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [rows[i].vec_id for i in want]


def test_message_tree(spark):
    n = lambda i, p, role, rank, text, deleted=False: (i, p, "t", role, rank, text, deleted, True, "ready_for_export")
    rows = [n("a", None, "prompter", None, "q"), n("b", "a", "assistant", 1, "worse"), n("c", "a", "assistant", 0, "better"), n("d", "c", "prompter", None, "more"), n("e", "d", "assistant", 0, "gone", True)]
    df = spark.createDataFrame(rows, "message_id string, parent_id string, message_tree_id string, role string, rank int, text string, deleted boolean, review_result boolean, tree_state string")
    got = adapters.best_paths(df).first()
    assert [(m.role, m.content) for m in got.messages] == [("user", "q"), ("assistant", "better")]


def test_adapters(spark):
    turns = [("human", "a"), ("gpt", "b")]
    df = spark.createDataFrame([(1, "s", turns), (2, "OASST-x", turns), (3, "", turns)], "id int, source string, messages array<struct<role:string,content:string>>")
    got = [r.reason for r in adapters.chat_rows(df, "p").orderBy("sample_id").collect()]
    assert sorted(map(str, got)) == ["None", "excluded_source", "missing_source"]
    df = spark.createDataFrame([("a", None, "b"), ("", "", "b"), ("a", "x", "")], "instruction string, input string, output string")
    assert [r.reason for r in adapters.instruction_rows(df, "p", "s").collect()] == [None, "empty_instruction", "empty_output"]


def test_extract(spark):
    df = spark.createDataFrame([(k, "x" * k) for k in range(10)], "k long, t string")
    backward = lambda texts: [{"index": i, "n": float(len(t))} for i, t in reversed(list(enumerate(texts)))]
    got = {r.k: r.n for r in extract.extract(df, "k", "t", lambda: backward, "n", "double", batch=3).collect()}
    assert got == {k: float(k) for k in range(10)}
    assert extract.mean_log_prob([None, -1.0, -3.0]) == -2.0
    waits, calls = [], iter([OSError(), OSError(), 5])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert extract.retried(call, wait=waits.append) == 5 and waits == [1, 2]


def test_pool(spark, tmp_path):
    rows = [(f"s{k}", f"src{k % 2}", [("user", f"question number {k}"), ("assistant", f"a long answer {k * 7919}")], None) for k in range(12)] + [("bad", "src0", [("user", "x")], "last_role_not_assistant")]
    df = spark.createDataFrame(rows, "sample_id string, source string, messages array<struct<role:string,content:string>>, reason string")
    out = pool.build(df, None, 8, near=False, base=2)
    assert out["pool"].count() == 8
    path = f"file://{tmp_path}/pool"
    manifest = pool.export(spark, out["pool"], path)
    assert manifest["count"] == 8
    docs = spark.read.json(f"{path}/docs")
    assert {r.check: r.failures for r in pool.audit(out["pool"], docs, 8).collect()} == dict.fromkeys(["rows", "duplicate_ids", "invalid_messages", "misaligned", "places"], 0)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        pool.export(spark, out["pool"], path)


def test_pool_query_builds_exports_and_audits(spark, monkeypatch):
    """Half the valid rows are asked for, decontaminated and without near copies; faults in the exported tables are seen."""
    seen, build, export = [], pool.build, pool.export
    monkeypatch.setattr(pool, "build", lambda *a, **k: seen.append((a, k, build(*a, **k))) or seen[-1][2])
    monkeypatch.setattr(pool, "export", lambda spark, made, path: export(spark, made.filter("candidate_index <> 2"), path))
    got = {r.check: r.failures for r in catalogue.QUERIES["candidate_pool_audit"](spark, "/root/testdata/sf0.01").collect()}
    (records, dev, target), options, out = seen[0]
    assert target == records.filter("reason IS NULL").count() // 2 > 5 and dev.count() == 40 and options.get("near", True)
    assert {"contaminated", "duplicates"} <= set(out) and out["pool"].count() > 5
    assert got == {"duplicate_ids": 0, "invalid_messages": 1, "misaligned": 1, "places": 0}


def test_near_duplicates_by_rounds(spark):
    """The sequential rule: a record goes if it shares a bucket with, and is similar to, an earlier kept one."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("abcdefghij"[c] * 2 for c in rng.integers(0, 10, n))
    rows = []
    for family in range(3):
        base = word(60)
        for k in range(40):  # near copies of one text, some farther from it than others
            cut = rng.integers(0, len(base) - 40)
            rows.append(base[:cut] + word(int(rng.integers(1, 9))) + base[cut + 12 :])
    rows += ["", "abc", None, rows[0], word(30)]
    texts = [(k, int(rng.integers(0, 4)), t) for k, t in enumerate(rows)]
    a, b = dedup.permutations(256, 42)
    kept, want = [], {}
    first = {}
    for k, p, t in sorted(texts, key=lambda r: (r[1], r[0])):
        t = t or ""
        if t in first:
            want[k] = (False, first[t], 1.0)
            continue
        first[t] = k
        s = {t[i : i + 5] for i in range(len(t) - 4)}
        sig = dedup.signature(sorted(s), a, b).reshape(32, 8)
        alike = [(-(len(s & s2) / len(s | s2) if s | s2 else 1.0), n, k2) for n, (k2, s2, sig2) in enumerate(kept) if (sig == sig2).all(axis=1).any()]
        best = min([x for x in alike if -x[0] >= 0.8], default=None)
        if best is None:
            kept.append((k, s, sig))
            want[k] = (True, None, None)
        else:
            want[k] = (False, best[2], round(-best[0], 6))
    df = spark.createDataFrame(texts, "k long, p int, t string")
    for size in (2, 8):
        got = {r.k: (r.kept, r.matched_id, r.similarity) for r in dedup.near(df, "k", "t", ["p"], 0.8, first=size).collect()}
        assert got == want
    assert dedup.near(df.limit(0), "k", "t", ["p"], 0.8).count() == 0


def test_contamination(spark):
    """Against a loop over all records and all dev records that share a bucket."""
    rng = np.random.default_rng(5)
    say = lambda n: " ".join("uvwxyz"[c] * 3 for c in rng.integers(0, 6, n))
    dev = [(f"d{k}", say(20), say(15)) for k in range(12)]
    dev += [("d0b", dev[0][1], dev[1][2]), ("a9", say(3), dev[2][2]), ("e", "", "ab")]
    rows = [(f"r{k}", say(20), say(15)) for k in range(10)]
    rows += [(f"x{k}", dev[k][1] if k % 3 == 0 else say(9), dev[k][2] if k % 3 == 1 else dev[k][2][:-2] + "qq") for k in range(12)]
    rows += [("s", say(4), "abc"), ("t", "", None), ("u", None, say(5)), ("v", say(5), rows[-1][2])]
    a, b = dedup.permutations(256, 42)

    def sketch(t):
        s = {t[i : i + 5] for i in range(len(t) - 4)}
        return s, dedup.signature(sorted(s), a, b).reshape(32, 8)

    want = {}
    for key, doc, prompt in rows:
        doc, prompt = doc or "", prompt or ""
        docs, prompts = [d[0] for d in dev if d[1] == doc], [d[0] for d in dev if d[2] == prompt]
        if docs:
            want[key] = (min(docs), "exact_doc", None)
        elif prompts:
            want[key] = (min(prompts), "exact_prompt", None)
        elif len(prompt) >= 5:
            s, sig = sketch(prompt)
            near = [(-len(s & o) / len(s | o), d[0]) for d in dev for o, so in [sketch(d[2])] if len(d[2]) >= 5 and (sig == so).all(axis=1).any()]
            best = min((x for x in near if -x[0] >= 0.8), default=None)
            if best:
                want[key] = (best[1], "prompt_minhash", round(-best[0], 6))
    frame = lambda r: spark.createDataFrame(r, "id string, doc string, prompt string")
    found = dedup.contamination(frame(rows), frame(dev).withColumnRenamed("id", "dev_id"), "id", "doc", "prompt", "dev_id")
    assert {r.id: (r.matched_id, r.match_type, r.similarity) for r in found.collect()} == want
    assert {m[1] for m in want.values()} == {"exact_doc", "exact_prompt", "prompt_minhash"}


def test_templates(spark, tmp_path):
    from heddle.functions import templates

    turns = [("user", "one\n\ntwo"), ("assistant", "three"), ("user", ""), ("assistant", None)]
    df = spark.createDataFrame([(turns,), ([],), (None,)], "m array<struct<role:string,content:string>>")
    got = {n: [r[0] for r in df.select(templates.render(F.col("m"), n)).collect()] for n in templates.names()}
    assert all(g[2] is None for g in got.values())
    assert got["claude"][:2] == ["\n\nHuman: one\n\ntwo\n\nAssistant: three\n\nHuman:Assistant:", "\n\n"]
    assert got["billa"][0] == "\nHuman: one\n\ntwo\nAssistant: three\nHuman: Assistant: "
    assert got["chatglm"][0] == "[Round 0]\n问：one\n\ntwo\n答：three\n[Round 1]\n问：答："
    assert got["falcon"][0] == "User: one\ntwo\n\nAssistant: three\n\nUser:Assistant:"
    assert got["llama-2"][0] == templates.RESPECTFUL + "one\n\ntwo[/INST] three </s><s>[INST][/INST]" and got["llama-2"][1] == ""
    assert got["rwkv"][0].startswith("Bob: hi\n\nAlice: Hi. I am") and got["rwkv"][0].endswith("Bob: one\ntwo\n\nAlice: three\n\nBob:Alice:")
    assert got["Robin"][0] == templates.HUMAN + "\n###Human:\none\n\ntwo\n###Assistant:\nthree\n###Human:\n###Assistant:\n"
    assert got["phoenix"][0] == templates.HUMAN + "\n\nHuman: <s>one\n\ntwo</s>Assistant: <s>three</s>Human: <s>Assistant: <s>"
    assert got["internlm-chat"][0].endswith("questions.\n\n<s><|User|>:one\n\ntwo<eoh>\n<|Bot|>:three<eoa>\n<s><|User|>:<|Bot|>:")
    assert got["zero_shot"][0] == templates.HUMAN + "\n### Human: one\n\ntwo\n### Assistant: three\n### Human:Assistant:"
    assert got["scorer"][0] == "one\n\ntwothree"
    path = tmp_path / "t.json"
    path.write_text('[{"name": "mine", "style": "internlm", "roles": ["U", "B"], "sep": "<e>", "sep2": "<f>", "system": "S"}]')
    assert templates.load(str(path)) == ["mine"]
    assert df.select(templates.render(F.col("m"), "mine")).first()[0] == "S<s>U:one\n\ntwo<e>\nB:three<f>\n<s>U:B:"
    with pytest.raises(ValueError):
        templates.register(templates.get("mine"))


def test_redundancy_filter(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(25, 6))
    x = np.concatenate([base, base[:9] + rng.normal(0, 0.2, (9, 6)), np.repeat(base[:1], 40, axis=0), np.zeros((3, 6))])
    rows = [(k, float(rng.integers(0, 6)), v.tolist()) for k, v in enumerate(x)] + [(999, 0.0, None)]
    kept = []
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    for k, _, v in sorted((r for r in rows if r[2]), key=lambda r: (r[1], r[0])):
        if all(unit(v) @ unit(o) <= 0.9 for _, o in kept):
            kept.append((k, v))
    df = spark.createDataFrame(rows, "k long, s double, v array<double>")
    for block, size in ((7, None), (2048, None), (7, 12), (16, 0)):
        got = selection.redundancy_filter(df, "k", "v", ["s"], 0.9, size, block).orderBy("rank").collect()
        assert [r.k for r in got] == [k for k, _ in kept][:size]
        assert [r["rank"] for r in got] == list(range(len(got)))
    assert selection.redundancy_filter(df.limit(0), "k", "v", ["s"]).count() == 0
    line = [(k, unit(v)) for k, _, v in sorted((r for r in rows if r[2]), key=lambda r: (r[1], r[0]))]
    for batch, size in ((1, None), (5, None), (5, 9), (100, None)):
        left = line[:1]
        for at in range(1, len(line), batch):
            part = line[at : at + batch]
            left = left + [(k, v) for n, (k, v) in enumerate(part) if all(v @ o <= 0.9 for _, o in left + part[:n])]
        got = selection.redundancy_filter(df, "k", "v", ["s"], 0.9, size, 7, batch).orderBy("rank").collect()
        assert [r.k for r in got] == [k for k, _ in left][:size]
    assert selection.redundancy_filter(df.limit(0), "k", "v", ["s"], batch=4).count() == 0
    assert len(line) > len(left) > 1


def test_logdet_draws(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "k long, embedding array<double>")
    u, pick = x / np.linalg.norm(x, axis=1, keepdims=True), np.random.default_rng(3)
    want = [np.linalg.slogdet(u[i] @ u[i].T + 0.1 * np.eye(20))[1] for i in (pick.choice(60, 20, replace=False) for _ in range(4))]
    assert geometric.logdet_draws(df.repartition(3), ["k"], size=20, trials=4, ridge=0.1, seed=3) == pytest.approx(want)
    assert geometric.logdet_draws(df.limit(0), ["k"], trials=2) == [0.0, 0.0]


def test_quota_sample(spark):
    import hashlib

    rows = [(k, "hot" if k % 3 else "ab"[k % 2], "t") for k in range(300)] + [(300, None, "t"), (301, "none", "t")]
    df = spark.createDataFrame(rows, "k long, source string, text string")
    quotas = {"hot": 70, "a": 500, "b": 3}
    order = lambda r: (hashlib.md5(f"9:{r[0]}".encode()).hexdigest(), r[0])
    want = {r for s, n in quotas.items() for r in sorted((r for r in rows if r[1] == s), key=order)[:n]}
    assert {tuple(r) for r in sampling.quota_sample(df, quotas, "k", seed=9).collect()} == want
    assert sampling.quota_sample(df, {}, "k").count() == 0
    assert sampling.quota_sample(df.limit(0), quotas, "k").count() == 0


def test_sentence_scores():
    same = ["a", "b", "c", "d", "e"]
    assert lexical.pairwise_bleu([same, same]) == pytest.approx(1)
    assert lexical.pairwise_bleu([same, ["v", "w", "x", "y", "z"]]) < 0.2
    assert kernel.ngram_vendi([same, same, same]) == pytest.approx(1)
    assert kernel.ngram_vendi([["a", "b"], ["c", "d"], ["e", "f"]]) == pytest.approx(3)
