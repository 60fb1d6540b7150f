"""Features from an outside model: texts go out in batches per task, results come back in the order asked."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

#: A transport takes a list of texts and returns one result per text as dicts with ``index``.
Transport = Callable[[list[str]], list[dict]]


def retried(call: Callable, tries: int = 5, wait: Callable[[float], None] = time.sleep):
    """``call()``, again after 1, 2, 4 … seconds (30 at most) on connection errors, time-outs and a status of 408, 429 or 5xx."""
    for k in range(tries):
        try:
            return call()
        except Exception as e:
            status = getattr(e, "status", None)
            if k == tries - 1 or status is not None and status < 500 and status not in (408, 429):
                raise
            wait(min(2**k, 30))


def in_order(results: list[dict], n: int) -> list[dict]:
    """Results by their index; each of 0 to n - 1 must be there once."""
    by = {r["index"]: r for r in results}
    if len(results) != n or set(by) != set(range(n)):
        raise ValueError(f"{len(results)} results do not answer {n} texts")
    return [by[k] for k in range(n)]


def mean_log_prob(tokens: list[float | None]) -> float:
    """The mean over all but the first token, which has no condition."""
    rest = [t for t in tokens[1:] if t is not None]
    if not rest:
        raise ValueError("fewer than two scored tokens")
    return sum(rest) / len(rest)


def extract(df: DataFrame, key: str, text: str, transport: Callable[[], Transport], field: str, kind: str, batch: int = 64) -> DataFrame:
    """key and ``field`` of every row, by a client made once a task."""

    def run(batches):
        send = transport()
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                texts = [t or "" for t in part.column(1).to_pylist()]
                got = in_order(retried(lambda texts=texts: send(texts)), len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[field] for g in got])], names=[key, field])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {field} {kind}")
