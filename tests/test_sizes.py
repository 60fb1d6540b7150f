"""Costs that must not grow faster than the input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.functions import vectors
from heddle.operators import geometric, lexical, selection
from heddle.plans import catalogue
from heddle.sources import tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_compared_without_copies(spark):
    x = np.random.default_rng(1).normal(size=(90, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<double>")

    def pairs(ka, x, others):
        return pa.table({"k": ka, "n": [sum(len(kb) for kb, _ in others)] * len(ka)})

    seen = vectors.compared(df, "k", "v", pairs, "k {key}, n long", rows=16, held=1024)
    assert "CartesianProduct" in _plan(seen) and "Generate" not in _plan(seen)
    assert {r.n for r in seen.groupBy("k").agg(F.sum("n").alias("n")).collect()} == {90}
    assert seen.count() > 90  # others came in several parts
    mean = geometric.novelsum(df, "k", "v")
    assert "collect_list" not in _plan(mean)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.sort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, 1:6].mean(axis=1)
    far = 1 - u @ u.T
    np.fill_diagonal(far, 0)
    w = 1 / np.arange(1, 91)
    assert abs(mean.first()[0] - (np.sort(far, axis=1) @ w / w.sum() / np.sqrt(near + 1e-9)).mean()) < 1e-9


def test_copies_of_vectors_have_the_least_keys_near(spark):
    df = spark.createDataFrame([(f"{i:03}", [1.0, 0.0]) for i in range(60)] + [("a", [0.0, 1.0])], "k string, v array<double>")
    got = {}
    for r in geometric.nearest(df, "k", "v", 2).collect():
        got.setdefault(r.k, {})[r["rank"]] = r.other
    assert got["000"] == {1: "001", 2: "002"} and got["059"] == got["a"] == {1: "000", 2: "001"} and got["001"] == {1: "000", 2: "002"}


def test_streams_read_a_table_of_many_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.QUERIES["streaming_ingest"](spark, f"file://{tmp_path}").count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_ngrams_are_shuffled_packed(spark):
    df = spark.createDataFrame([("a b c a b",), ("",), ("a b",), (None,)], "t string")
    made = lexical.profile(df, F.split(F.coalesce("t", F.lit("")), " "), [1, 2, 3], threshold=1)
    assert "Generate" not in _plan(made)
    got = {r.n: (r.d, r.total, r.r) for r in made.groupBy("n").agg(F.sum("d").alias("d"), F.sum("total").alias("total"), F.sum("r").alias("r")).collect()}
    assert got == {1: (4, 9, 1), 2: (3, 5, 2), 3: (3, 3, 3)}


def test_no_text_goes_to_python_for_type_counts(spark):
    df = spark.createDataFrame([(1, ["a"] * 30 + ["b"] * 30), (2, []), (3, None)], "k long, w array<string>")
    assert "ArrowEvalPython" in _plan(lexical.vocd(df, F.col("w"), "k")) and "xxhash64" in _plan(lexical.vocd(df, F.col("w"), "k"))
    assert [r.k for r in lexical.vocd(df, F.col("w"), "k").collect()] == [1]


def test_windows_of_characters_are_not_made_as_texts(spark):
    df = spark.createDataFrame([("abcabc",), ("ab",), (None,), ("\U0001f600" * 6,)], "t string").select(X.char_ngram_count(F.col("t"), 3).alias("n"))
    assert "array_join" not in _plan(df) and [r.n for r in df.collect()] == [3, 0, 0, 1]


def test_facility_picks_take_no_jobs_of_their_own(spark):
    """Copies too: of equal gains the least key is picked."""
    x = np.random.default_rng(3).normal(size=(150, 6))
    x[40:60], x[7] = x[5], 0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s, best, want, jobs = np.maximum(u @ u.T, 0), np.zeros(150), [], []
    while len(want) < 140:
        gain = np.round(np.maximum(s - best[:, None], 0).sum(axis=0), 9)
        gain[want] = -1
        want.append(int(gain.argmax()))
        best = np.maximum(best, s[:, want[-1]])
    for k in (3, 140):
        spark.sparkContext.setJobGroup(f"facility{k}", "")
        assert selection.facility_rows(df, k, weighed=8) == want[:k]
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"facility{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] and selection.facility_rows(df.limit(0), 3) == []


def test_others_are_read_no_more_often_for_more_blocks(spark):
    from pyspark import TaskContext

    df = spark.range(600).select(F.col("id").alias("k"), F.array(F.col("id") * 1.0).alias("v"))

    def kernel(ka, x, others):
        here, n = TaskContext.get().partitionId(), sum(len(kb) for kb, _ in others)
        return pa.table({"k": ka, "at": [here] * len(ka), "n": [n] * len(ka), "rows": [len(ka)] * len(ka)})

    seen = vectors.compared(df, "k", "v", kernel, "k {key}, at long, n long, rows long", rows=4).collect()
    assert sorted(r.k for r in seen) == list(range(600)) and {r.n for r in seen} == {600}
    assert len({r["at"] for r in seen}) <= 48 and max(r.rows for r in seen) <= 5


def test_contents_of_files_do_not_come_to_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", None)
    kept = [(f"a b%20{i}.bin", bytearray(range(256)) * (i + 1)) for i in range(9)]
    df = spark.createDataFrame(kept, "name string, content binary").repartition(4)
    for path in (f"file://{tmp_path}/x y", f"{tmp_path}/z"):
        for _ in range(2):  # again over what is there
            assert tables.write_files(df, path) == sorted(n for n, _ in kept)
        found = tmp_path / path.rsplit("/", 1)[1]
        assert {p.name: p.read_bytes() for p in found.iterdir()} == {n: bytes(c) for n, c in kept}
        assert spark.read.format("binaryFile").load(path).count() == 9


def test_sqlite_tables_are_many_files(spark, sf, tmp_path, monkeypatch):
    e, made = spark.read.parquet(f"{sf}/embeddings.parquet"), []
    e.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    write = tables.write_files
    monkeypatch.setattr(tables, "write_files", lambda *a: made.extend(write(*a)))
    got = catalogue.QUERIES["sqlite_tables"](spark, f"file://{tmp_path}").collect()
    assert len(made) > 1 and {r["column"]: r.rows for r in got} == dict.fromkeys(("doc_id", "embedding", "ln_p"), e.count())
