"""Helpers that the corpus operators share: table access, shared folders, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``).

    Where the session names none, a local master, as in tests, uses a temporary folder; a cluster has no such place, so
    there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/heddle"
    return f"{base.rstrip('/')}/heddle-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes to the shared folder and reads back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote. For tables that nothing still to be computed reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def trained_on(doc_id: Column) -> Column:
    """True for the rows labels may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def spread(*cols: Column) -> Column:
    """A reproducible order without relation to the data: used to sample and to shuffle."""
    return F.xxhash64(*cols, F.lit(7919))


def pieces(batch: pa.RecordBatch, rows: int, text: str | None = None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``most`` bytes of the column ``text``; one row at least."""
    n = batch.num_rows
    if text is None:
        sizes = None
    else:
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < n:
        stop = min(n, start + rows)
        if sizes is not None:
            held = sizes[start:stop].cumsum()
            stop = start + max(1, int((held <= most).sum()))
        yield batch.slice(start, stop - start)
        start = stop


def append(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable], rows: int = 512) -> DataFrame:
    """Appends columns computed from one text column in Arrow batches.

    ``make`` runs once a task and returns a function from a list of texts (null as ``None``) to one
    sequence per field. An input column named like a new field is replaced; all others stay.
    """
    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches):
        f = None
        for batch in batches:
            for part in pieces(batch, rows, text):
                f = f or make()
                got = f(part.column(text).to_pylist())
                made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(got, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, schema=pa.schema([*(part.schema.field(c) for c in keep), *(pa.field(x.name, a.type) for x, a in zip(fields, made, strict=True))]))

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
