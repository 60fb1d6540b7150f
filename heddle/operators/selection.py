"""Subset selection: farthest points, novelty, redundancy filter, facility location, scores.

Greedy rules pick one row at a time by the state of all: each step is one Spark job over the rows (a
running minimum is kept in a written table), and only the picked row comes to the driver (facility location does all its steps in one stage). For pools that
fit a worker, the kernels below do the same in one task.
"""

from __future__ import annotations

import itertools
import math
import pickle
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.tables import materialize, shared_dir
from . import sampling


def k_center(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", space: str = "embedding", every: int = 8) -> list[int]:
    """Keys of k rows: the least key first, then always the row farthest from those picked. Ties by key.

    ``space="norm"`` compares lengths of the vectors only. Every few steps the running minimum distances
    are written, so the plan stays short.
    """
    x = F.col(vector) if space == "embedding" else F.array(vectors.norm(F.col(vector)))
    rows = df.select(F.col(key).alias("k"), F.transform(x, lambda v: v.cast("double")).alias("x"))
    rows = materialize(rows.withColumn("far", F.lit(float("inf"))))
    picked: list[int] = []
    while len(picked) < k:
        best = rows.filter(~F.col("k").isin(picked)) if picked else rows
        r = best.agg(F.max(F.struct("far", (-F.col("k")).alias("n"), "x")).alias("m")).first().m if picked else best.agg(F.min(F.struct("k", "x")).alias("m")).first().m
        if r is None:
            break
        picked.append(int(-r["n"]) if "n" in r else int(r["k"]))
        here = F.array(*[F.lit(float(v)) for v in r["x"]])
        rows = rows.withColumn("far", F.least("far", vectors.euclidean(F.col("x"), here)))
        if len(picked) % every == 0:
            rows = materialize(rows)
    return picked


def k_center_kernel(x: np.ndarray, k: int) -> list[int]:
    """The same rule on a matrix: places of the rows."""
    picked, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(k, len(x)):
        far[picked] = -1
        picked.append(int(far.argmax()))
        far = np.minimum(np.where(far < 0, np.inf, far), np.linalg.norm(x - x[picked[-1]], axis=1))
    return picked


def novelty(x: np.ndarray, k: int, rho: np.ndarray, power: float = 1.0, first: int = 0) -> list[int]:
    """Greedy by the mean, over the picked rows, of distance times both densities, nearer ones weighing more."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    picked = [first]
    cols = [(1 - u @ u[first]) * (rho + rho[first])]
    while len(picked) < min(k, len(x)):
        d = np.sort(np.stack(cols, axis=1), axis=1)
        gain = (d / np.arange(1, d.shape[1] + 1) ** power).mean(axis=1)
        gain[picked] = -np.inf
        picked.append(int(gain.argmax()))
        cols.append((1 - u @ u[picked[-1]]) * (rho + rho[picked[-1]]))
    return picked


def redundancy_filter(df: DataFrame, key: str, vector: str, order: list[str], threshold: float = 0.92, size: int | None = None, block: int = 2048, batch: int | None = None) -> DataFrame:
    """rank and key of the rows, in order, whose cosine with every earlier kept row is at most ``threshold``; the first ``size`` of them.

    The next ``block`` rows in order are settled among themselves (the only rows that come to the driver); then one
    pass without a shuffle drops all rows too similar to what was kept of them. No pairs are written, so groups of
    copies cost no more than other rows, and the work ends as soon as ``size`` rows are found. A row of zeros is
    similar to none; rows without a vector are left out. Ties in the order go by key.

    With ``batch`` the rows after the first go in batches of so many, and a row also goes if an earlier one of its
    batch is too similar, kept or not.
    """
    spark = df.sparkSession
    rest = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.struct(*order, key).alias("o"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    if batch:
        rest = _first_in_batch(rest, batch, threshold)
    rest, path, kept = materialize(rest), shared_dir(spark), 0
    kind = f"rank long, {key} {df.schema[key].dataType.simpleString()}"
    spark.createDataFrame([], kind).write.parquet(path)
    while True:
        top = rest.orderBy("o").limit(block).collect()  # at most ``block`` rows
        if not top:
            break
        x = _unit(np.array([r.x for r in top], float))
        close, alive = x @ x.T > threshold, np.ones(len(top), bool)
        for i in range(len(top)):
            if alive[i]:
                alive[i + 1 :] &= ~close[i, i + 1 :]
        picked = np.flatnonzero(alive)[: None if size is None else size - kept]
        spark.createDataFrame([(kept + n, top[i].k) for n, i in enumerate(picked)], kind).coalesce(1).write.mode("append").parquet(path)
        kept += len(picked)
        if len(top) < block or kept == size:
            break
        seen = spark.createDataFrame([(r.k,) for r in top], f"k {df.schema[key].dataType.simpleString()}")
        rest = materialize(_apart(rest.join(F.broadcast(seen), "k", "left_anti"), x[alive], threshold))
    return spark.read.schema(kind).parquet(path)


def _first_in_batch(rows: DataFrame, batch: int, threshold: float) -> DataFrame:
    """Rows (o, x) without a similar one before them in their batch. Those left of a batch are far from each other, so only
    kept rows of earlier batches can still remove them: the rule by batches is the rule row by row over these."""

    def far(t: pa.Table) -> pa.Table:
        t = t.sort_by("_at")
        u = _unit(vectors.matrix(t["x"]))
        return t.filter(pa.array(~np.tril(u @ u.T > threshold, -1).any(axis=1))).select(["k", "o", "x"])

    number = F.when(F.col("_at") == 0, F.lit(0)).otherwise(F.floor((F.col("_at") - 1) / batch) + 1)
    return sampling.placed(rows, ["o"], "_at").withColumn("_batch", number).groupBy("_batch").applyInArrow(far, rows.schema)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _apart(rows: DataFrame, kept: np.ndarray, threshold: float) -> DataFrame:
    """Rows (with a column x) whose cosine with none of the unit vectors ``kept`` is above the threshold."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                far = (_unit(vectors.matrix(b.column(b.schema.get_field_index("x")))) @ kept.T).max(axis=1) <= threshold
                yield b.filter(pa.array(far))

    return rows.mapInArrow(run, rows.schema)


def facility_location(x: np.ndarray, k: int) -> list[int]:
    """Greedy maximum of the summed greatest cosine, with lazy re-evaluation of gains."""
    import heapq

    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.maximum(u @ u.T, 0)
    best = np.zeros(len(x))
    heap = [(-float(c.sum()), i, 0) for i, c in enumerate(s.T)]
    heapq.heapify(heap)
    picked: list[int] = []
    while heap and len(picked) < k:
        gain, i, at = heapq.heappop(heap)
        if at == len(picked):
            picked.append(i)
            best = np.maximum(best, s[:, i])
        else:
            heapq.heappush(heap, (-float(np.maximum(s[:, i] - best, 0).sum()), i, len(picked)))
    return picked


def novelty_rows(df: DataFrame, k: int, rho: DataFrame, key: str = "vec_id", vector: str = "embedding", power: float = 1.0, every: int = 8) -> list[int]:
    """Keys of k rows of a whole table by the rule of ``novelty``: the least key first; ties by key.

    ``rho`` has the key and a density of each row. A job per picked row: every batch yields its best row, and only those
    come to the driver. Every few steps the rows' weighted distances to what was picked are written.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("x"))
    rows = rows.join(rho.select(F.col(key).cast("long").alias("k"), "rho"), "k", "left").select("k", F.transform("x", lambda v: v.cast("double")).alias("x"), F.coalesce("rho", F.lit(1.0)).alias("rho"), F.array().cast("array<double>").alias("far"))
    rows = materialize(rows)
    first = rows.agg(F.min(F.struct("k", "x", "rho")).alias("m")).first().m
    picked, new = ([first] if first and k > 0 else []), []
    while picked and len(picked) < k:
        new.append(picked[-1])
        u, dense, gone = _unit(np.array([r.x for r in new], float)), np.array([r.rho for r in new]), np.array([r.k for r in picked])

        def run(batches, u=u, dense=dense, gone=gone, best=True):
            for b in batches:
                if not b.num_rows:
                    continue
                x, r = vectors.matrix(b.column(1)), b.column(2).to_numpy()
                far = np.concatenate([vectors.matrix(b.column(3)), (1 - _unit(x) @ u.T) * (r[:, None] + dense)], axis=1)
                if not best:
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1]), pa.array(far.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), rows], names=["k", "x", "rho", "far"])
                    continue
                gain = np.round((np.sort(far, axis=1) / np.arange(1, far.shape[1] + 1) ** power).mean(axis=1), 12)
                keys = b.column(0).to_numpy()
                gain[np.isin(keys, gone)] = -np.inf
                i = int(np.lexsort((keys, -gain))[0])
                if gain[i] > -np.inf:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 1]), b.column(1).slice(i, 1), pa.array(r[i : i + 1]), pa.array(gain[i : i + 1])], names=["k", "x", "rho", "gain"])

        top = rows.mapInArrow(run, "k long, x array<double>, rho double, gain double").orderBy(F.desc("gain"), "k").first()
        if top is None:
            break
        picked.append(top)
        if len(new) == every:
            rows, new = materialize(rows.mapInArrow(lambda batches, f=run: f(batches, best=False), rows.schema)), []
    return [r.k for r in picked]


def _exchange(here, secret: bytes):
    """For the tasks of a barrier stage: a function that sends a tuple and returns those of all tasks, in order, and one that ends it.

    Spark's own ``allGather`` takes a second a call, so it only makes known where task 0 listens; the others connect to it
    with the stage's secret. A task that is lost closes its connection, the others fail, and Spark runs the stage again.
    """
    from multiprocessing.connection import Client, Listener

    me, at = here.partitionId(), [i.address.rsplit(":", 1)[0] for i in here.getTaskInfos()]
    if me:
        host, port = here.allGather("")[0].rsplit(":", 1)
        hub = Client((host, int(port)), authkey=secret)
        hub.send(me)

        def told(*own):
            hub.send(own)
            return hub.recv()

        return told, hub.close
    listener = Listener((at[0], 0), backlog=len(at), authkey=secret)
    here.allGather(f"{at[0]}:{listener.address[1]}")
    of = {}
    while len(of) < len(at) - 1:
        c = listener.accept()
        of[c.recv()] = c

    def told(*own):
        got = [own, *(of[i].recv() for i in range(1, len(at)))]
        whole = pickle.dumps(got)
        for c in of.values():
            c.send_bytes(whole)
        return got

    return told, listener.close


def facility_rows(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 2048, weighed: int = 64, every: int = 64) -> list[int]:
    """Keys of k rows of a whole table by the rule of ``facility_location``; ties by key.

    One barrier stage of as many tasks as run at once, with ``every`` rows each or more. A task holds its rows' vectors, best
    similarities and gains, and hears of other tasks' rows at most ``block`` a task at a time. Each round the tasks propose up to
    ``weighed`` rows of the highest gains and weigh all of these exactly. Two rows meet where both would better the same row. A
    row that meets none of a higher gain keeps its gain until the greedy rule comes to it, so a round picks all such rows, and
    the order of picks is the order of their gains. The rows that the picks bettered are then passed round, which keeps
    the gains of all others true: each row is passed as often as it is bettered, not once a pick.
    """
    item = "f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "f8"
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("x"))
    n = rows.count()
    most, spark = min(k, n), df.sparkSession.sparkContext._jsc.sc()
    if most < 1:
        return []
    tasks = max(1, min(spark.maxNumConcurrentTasks(spark.resourceProfileManager().defaultResourceProfile()), -(-n // every)))
    secret = secrets.token_bytes(32)
    least = 1e-14  # less is what rounding makes of equal similarities

    def run(batches):
        from pyspark import BarrierTaskContext

        here = BarrierTaskContext.get()
        told, close = _exchange(here, secret)
        held = [(b.column(0).to_numpy(), vectors.matrix(b.column(1)).astype(item)) for b in batches if b.num_rows]
        width = max(w for (w,) in told(held[0][1].shape[1] if held else 0))
        keys, x = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros((0, width), item)), *held, strict=True))
        u, best, gain, free = _unit(x.astype(float)), np.zeros(len(x)), np.zeros(len(x)), np.ones(len(x), bool)

        def passed(at, low, high):
            """Of each own row, the sum over the rows ``at`` of all tasks of how far its similarity is above ``low``, up to ``high``."""
            total, s, more = np.zeros(len(x)), 0, True
            while more:
                got = told(x[at[s : s + block]], low[s : s + block], high[s : s + block], len(at) > s + block)
                y, a, b = (np.concatenate(c) for c in list(zip(*got, strict=True))[:3])
                y = _unit(y.astype(float))
                for i, j in itertools.product(range(0, len(y), 64), range(0, len(x), 1024)):  # as much as a core's cache holds
                    c, a_, b_ = y[i : i + 64] @ u[j : j + 1024].T, a[i : i + 64, None], b[i : i + 64, None]
                    np.minimum(np.maximum(c, a_, out=c), b_, out=c)
                    total[j : j + 1024] += c.sum(axis=0) - a_.sum()
                s, more = s + block, any(m[3] for m in got)
            return total

        gain += passed(np.arange(len(x)), best, np.full(len(x), np.inf))
        place = lambda g, i: (round(float(g), 9), -int(i))
        found, turns = [], 2
        while True:
            left = np.flatnonzero(free)
            g = np.round(gain[left], 9)
            if len(left) > turns + 1:
                left = left[g >= np.partition(g, len(g) - turns - 1)[len(g) - turns - 1]]
            left = left[np.lexsort((keys[left], -np.round(gain[left], 9)))]
            top, rest = left[:turns], left[turns : turns + 1]
            got = told(keys[top], x[top], gain[top], [place(gain[i], keys[i]) for i in rest])
            ks, xs, gs = (np.concatenate(c) for c in list(zip(*got, strict=True))[:3])
            start = sum(len(m[0]) for m in got[: here.partitionId()])
            if not len(ks) or len(found) >= most and sorted(found, reverse=True)[most - 1] >= max(place(g, i) for g, i in zip(gs, ks, strict=True)):
                break
            bound = max([p for m in got for p in m[3]], default=(-np.inf, 0))
            c = u @ _unit(xs.astype(float)).T
            over = c - best[:, None]
            over[over <= least] = 0
            hit = over[over.any(axis=1)].astype(bool).astype(np.float32)
            got = told(over.sum(axis=0), np.packbits(hit.T @ hit > 0))
            gs = np.sum([m[0] for m in got], axis=0)
            meet = np.unpackbits(np.bitwise_or.reduce([m[1] for m in got]), count=len(ks) ** 2).reshape(len(ks), -1).astype(bool)
            taken, met, seen = [], np.zeros(len(ks), bool), 0
            for i in np.lexsort((ks, -np.round(gs, 9))):
                if seen and place(gs[i], ks[i]) < bound:
                    break
                if not met[i]:
                    taken.append(i)
                met |= meet[i]
                seen += 1
            found += [place(gs[i], ks[i]) for i in taken]
            gain[top] = gs[start : start + len(top)]
            free[[top[i - start] for i in taken if start <= i < start + len(top)]] = False
            new = c[:, taken].max(axis=1)
            at = np.flatnonzero(new - best > least)
            gain -= passed(at, best[at], new[at])
            best[at] = new[at]
            turns = min(weighed, 2 * turns) if 2 * len(taken) > seen else max(2, turns // 2) if 8 * len(taken) < seen else turns
        if here.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([-i for _, i in sorted(found, reverse=True)[:most]], pa.int64())], names=["k"])
        close()

    return [r.k for r in rows.repartition(tasks).mapInArrow(run, "k long", barrier=True).collect()]  # k keys


def expected_quality(logits: list[float | None]) -> float:
    """The mean of 1 to 6 under the softmax of six logits; 3 where one is missing."""
    if len(logits) != 6 or any(v is None or not math.isfinite(v) for v in logits):
        return 3.0
    e = np.exp(np.array(logits) - max(logits))
    return float((e / e.sum() * np.arange(1, 7)).sum())


def final_score(*scores: str):
    """The sum over turns of the product of the turn's scores (arrays of equal length)."""
    first, *rest = scores
    c = F.transform(F.col(first), lambda x: x.cast("double"))
    for s in rest:
        c = F.zip_with(c, F.col(s), lambda x, y: x * y)
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def pipeline(rows: DataFrame, judged: DataFrame, embedded: DataFrame, key: str, scores: list[str], threshold: float = 0.92, size: int | None = None, vector: str = "embedding") -> DataFrame:
    """rank, the columns of ``rows``, and score: the best-scored rows whose vectors are not too near to a better one's.

    ``judged`` has the key and an array for each name in ``scores``, ``embedded`` the key and a vector. Rows without either
    are left out.
    """
    scored = judged.select(key, final_score(*scores).alias("score")).join(embedded.select(key, vector), key)
    scored = materialize(scored.withColumn("_down", -F.col("score")))
    kept = redundancy_filter(scored, key, vector, ["_down"], threshold, size)
    return kept.join(scored.select(key, "score"), key).join(rows, key).select("rank", *rows.columns, "score")
