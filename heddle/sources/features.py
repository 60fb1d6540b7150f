"""Vectors and scores of outside tools: SQLite tables, NPZ archives and pickled frames, read and written as files of bytes.

Files come through Spark's ``binaryFile`` source, one row each, and are opened from memory in the tasks. Pickled values may
hold arrays only; whole pickled frames are read on the caller's word that they can be trusted.
"""

from __future__ import annotations

import io
import pickle
import sqlite3

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "doc_id long, embedding array<double>, ln_p double"
#: What a pickled vector may be made of.
PLAIN = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer"), ("_codecs", "encode")}


class _Arrays(pickle.Unpickler):
    def find_class(self, module, name):
        if (module, name) not in PLAIN:
            raise pickle.UnpicklingError(f"{module}.{name} is no part of an array")
        return super().find_class(module, name)


def vector(blob: bytes | str | None) -> list[float] | None:
    """A pickled array or list, or JSON text, as numbers."""
    if blob is None:
        return None
    if isinstance(blob, str):
        import json

        return [float(x) for x in json.loads(blob)]
    return [float(x) for x in np.asarray(_Arrays(io.BytesIO(blob)).load()).ravel()]


def _opened(content: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    return con


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def files(spark: SparkSession, path: str) -> DataFrame:
    """name and content of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def read_sqlite(spark: SparkSession, path: str, columns: tuple[str, str, str] | None = ("doc_id", "embedding", "ln_p")) -> DataFrame:
    """name, doc_id, embedding and ln_p of the feature tables in SQLite files, a row per document.

    The table named like the file is read, else the first one. ``columns`` names the three; None takes the first, the fourth and the
    fifth, as old files have them (the fifth may be missing).
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                con = _opened(content)
                tables = [t for (t,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY rowid")]
                found = next((t for t in tables if t == name.rsplit(".", 1)[0]), tables[0] if tables else None)
                rows = []
                if found and columns:
                    rows = con.execute(f"SELECT {', '.join(map(_quoted, columns))} FROM {_quoted(found)}").fetchall()
                elif found:
                    rows = [(r[0], r[3], r[4] if len(r) > 4 else None) for r in con.execute(f"SELECT * FROM {_quoted(found)}")]
                con.close()
                for s in range(0, len(rows), 1024):
                    part = rows[s : s + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([int(r[0]) for r in part], pa.int64()), pa.array([vector(r[1]) for r in part], pa.list_(pa.float64())), pa.array([r[2] for r in part], pa.float64())], names=["name", "doc_id", "embedding", "ln_p"])

    return files(spark, path).mapInArrow(run, f"name string, {ROWS}")


def sqlite_files(df: DataFrame, name: str = "features", rows: int = 100_000) -> DataFrame:
    """name and content of SQLite files, one for each part of the table, with its rows of doc_id, embedding (pickled) and ln_p."""

    def run(batches):
        import uuid

        con, n = None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if con is None:
                    con = sqlite3.connect(":memory:")
                    con.execute(f"CREATE TABLE {_quoted(name)} (doc_id INTEGER PRIMARY KEY, embedding BLOB, ln_p REAL)")
                con.execute(f"INSERT INTO {_quoted(name)} VALUES (?, ?, ?)", (r["doc_id"], pickle.dumps(np.array(r["embedding"], np.float64)), r["ln_p"]))
                n += 1
                if n % rows == 0:
                    yield _file(uuid.uuid4().hex, con)
                    con = None
        if con is not None:
            yield _file(uuid.uuid4().hex, con)

    def _file(part, con):
        con.commit()
        return pa.RecordBatch.from_arrays([pa.array([f"{name}-{part}.db"]), pa.array([con.serialize()], pa.binary())], names=["name", "content"])

    return df.select("doc_id", "embedding", "ln_p").mapInArrow(run, "name string, content binary")


def inspect_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """name, table_name, kind, column, type and rows of every table and view of SQLite files."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                con, out = _opened(content), []
                for t, kind in con.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') ORDER BY name").fetchall():
                    n = con.execute(f"SELECT count(*) FROM {_quoted(t)}").fetchone()[0]
                    out += [(name, t, kind, c[1], c[2], n) for c in con.execute(f"PRAGMA table_info({_quoted(t)})")]
                con.close()
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*[pa.string()] * 5, pa.int64()], strict=True)], names=["name", "table_name", "kind", "column", "type", "rows"])

    return files(spark, path).mapInArrow(run, "name string, table_name string, kind string, column string, type string, rows long")


def read_npz(spark: SparkSession, path: str, ids: str = "ids", values: str = "embeddings", key: str = "sample_id") -> DataFrame:
    """key (text) and ``value`` of the archives below a path: arrays of numbers, single numbers as arrays of one. Both arrays must be equally long."""

    def run(batches):
        for batch in batches:
            for content in batch.column(1).to_pylist():
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    i, v = z[ids], np.asarray(z[values], np.float64)
                if len(i) != len(v):
                    raise ValueError(f"{len(i)} ids for {len(v)} rows")
                v = v.reshape(len(v), -1)
                for s in range(0, len(v), 1024):
                    part = v[s : s + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array(i[s : s + 1024].astype(str).tolist()), pa.array(part.tolist(), pa.list_(pa.float64()))], names=[key, "value"])

    return files(spark, path).mapInArrow(run, f"{key} string, value array<double>")


def npz_files(df: DataFrame, key: str, value: str, ids: str = "ids", values: str = "embeddings", rows: int = 100_000) -> DataFrame:
    """name and content of NPZ archives of ids and values, one or more for each part of the table."""

    def run(batches):
        import uuid

        held: list[tuple] = []
        for batch in (*batches, None):
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if batch is not None else []
            while len(held) >= rows or batch is None and held:
                part, held = held[:rows], held[rows:]
                out = io.BytesIO()
                np.savez(out, **{ids: np.array([str(k) for k, _ in part]), values: np.array([v for _, v in part], np.float64)})
                yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.npz"]), pa.array([out.getvalue()], pa.binary())], names=["name", "content"])

    return df.select(key, value).mapInArrow(run, "name string, content binary")


def read_pickled_frames(spark: SparkSession, path: str, schema: str, trusted: bool = False) -> DataFrame:
    """Rows of pandas frames pickled in the files below a path, zipped or plain. Pickles run code: ``trusted`` must be set."""
    if not trusted:
        raise ValueError("a pickled frame can run any code; set trusted=True for files of your own")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                frame = pd.read_pickle(io.BytesIO(content), compression="zip" if content[:2] == b"PK" else None)
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return files(spark, path).mapInArrow(run, schema)


def checked(features: DataFrame, wanted: DataFrame, key: str, value: str = "value") -> DataFrame:
    """check and failures of features against the rows they belong to: missing, unknown and repeated keys, other lengths, numbers that are none."""
    from ..functions.vectors import finite

    one = lambda name, df: df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
    size = features.agg(F.max(F.size(value))).first()[0] or 0
    parts = [
        one("missing", wanted.select(key).join(features.select(key), key, "left_anti")),
        one("unknown", features.select(key).join(wanted.select(key), key, "left_anti")),
        one("repeated", features.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")),
        one("length", features.filter(F.col(value).isNull() | (F.size(value) != size))),
        one("not_finite", features.filter(~finite(F.col(value)))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def aligned(features: DataFrame, wanted: DataFrame, key: str, place: str, value: str = "value") -> DataFrame:
    """key, place and value in the order of ``wanted``; an error where a check fails."""
    bad = [r for r in checked(features, wanted, key, value).collect() if r.failures]  # a row per check
    if bad:
        raise ValueError(", ".join(f"{r.failures} {r['check']}" for r in bad))
    return wanted.select(key, place).join(features.select(key, value), key)
