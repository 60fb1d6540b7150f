"""Reading and writing: records in JSON and Parquet, shared folders, row-aligned exports."""

from __future__ import annotations

import json
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``. Where the session names none a local master uses a temporary folder; a cluster has no such place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/heddle"
    return f"{base.rstrip('/')}/heddle-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes to the shared folder and reads back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote, once nothing still to be computed reads them."""
    for t in written:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def read_json(spark: SparkSession, path: str, schema: T.StructType, lines: bool = True, wrapped: str | None = None) -> DataFrame:
    """Records of JSON lines, of one JSON array or object, or of the list under the key ``wrapped``; gzip by extension. A line that is no object fails."""
    reader = spark.read.option("mode", "FAILFAST")
    if wrapped:
        whole = T.StructType([T.StructField(wrapped, T.ArrayType(schema))])
        return reader.schema(whole).option("multiLine", True).json(path).select(F.inline(wrapped))
    return reader.schema(schema).option("multiLine", not lines).json(path)


def read_folder(spark: SparkSession, path: str, kind: str = "json", schema: T.StructType | None = None) -> DataFrame:
    """All files below a folder, with ``_path`` for an explicit order."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).format(kind).load(path).withColumn("_path", F.col("_metadata.file_path"))


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines that are not blank, without parsing."""
    return spark.read.text(path).filter(F.trim("value") != "").count()


def write_jsonl(df: DataFrame, path: str, order: str | None = None, mode: str = "errorifexists") -> None:
    """JSON lines; with ``order`` one sorted range per part, so the parts in name order are the rows in order."""
    out = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
    out.write.mode(mode).option("ignoreNullFields", False).json(path)


def content_hash(df: DataFrame) -> str:
    """A hash of the rows that does not depend on their order or files."""
    total = df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    return f"{total.n}:{total.h}"


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """A small JSON document in the store of ``path``."""
    text = json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n")


def exported(spark: SparkSession, path: str) -> bool:
    """Whether a finished table stands at ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_removals(removed: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """One folder of JSON lines per stage."""
    for stage, df in removed.items():
        write_jsonl(df, f"{path}/{stage}", mode=mode)


def read_files(spark: SparkSession, paths: list[str], kind: str = "parquet") -> DataFrame:
    """A fixed list of files; all that are missing are named in one error."""
    conf = spark._jsc.hadoopConfiguration()
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    missing = [p for p in paths if not place(p).getFileSystem(conf).exists(place(p))]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return spark.read.format(kind).load(paths)


def read_shards(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON files named 0.json, 1.json … with ``_shard``, their number, for an explicit order."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json", 1).cast("int")
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_shard", number)


def summary(df: DataFrame) -> DataFrame:
    """column, n, nulls, least and greatest of every column that can be ordered, in one pass."""
    stats = lambda c: F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest"))
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)]
    return df.agg(F.array(*[stats(c) for c in plain]).alias("s")).select(F.inline("s"))


def first_line(spark: SparkSession, path: str) -> str:
    found = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()  # one row
    return found[0].value.strip() if found else ""


def read_any_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of one JSON array or of JSON lines, told apart by the first line: one that is a whole object makes lines."""
    line = first_line(spark, path)
    try:
        lines = not line or isinstance(json.loads(line), dict)
    except ValueError:
        lines = False
    return read_json(spark, path, schema, lines=lines)


def count_records(spark: SparkSession, path: str) -> int:
    """Lines of JSON lines, elements of one JSON array, or keys of one object; records are not parsed into columns."""
    line = first_line(spark, path)
    try:
        whole = not isinstance(json.loads(line), dict) if line else False
    except ValueError:
        whole = True
    if not whole and count_rows(spark, path) > 1:
        return count_rows(spark, path)
    n = F.when(F.ltrim("value").startswith("["), F.json_array_length("value")).otherwise(F.size(F.json_object_keys("value")))
    return spark.read.text(path, wholetext=True).agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that is there: raw files, say, else processed ones."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def open_dataset(spark: SparkSession, name: str, resolve=None, kind: str = "parquet", split: str | None = None) -> DataFrame:
    """A table at a path, or of a split below it (the first split in name order where the one asked for is missing).

    A name that is no path goes to ``resolve``, which returns a path for it; without one it is an error.
    """
    if not path_exists(spark, name):
        if resolve is None:
            raise FileNotFoundError(f"{name} is no path, and nothing resolves names")
        name = resolve(name)
    if split is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        below = sorted(f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if f.isDirectory())
        name = f"{name}/{split if split in below else below[0]}"
    return spark.read.format(kind).load(name)


def reusable(spark: SparkSession, paths: list[str], overwrite: bool = False) -> bool:
    """Whether a stage can be skipped: all of its tables are finished. Some but not all is an error, unless they are overwritten."""
    done = [p for p in paths if exported(spark, p)]
    if overwrite or not done:
        return False
    if len(done) < len(paths):
        raise FileExistsError(f"only a part of the stage is there: {', '.join(done)}")
    return True


def write_files(files: DataFrame, path: str) -> list[str]:
    """Writes rows of name and content (binary) as files; the names, in order.

    The tasks write each file under a hidden name, which readers pass over, and the driver renames those of the tasks that ended well: only
    names come to it. A store that Arrow cannot open is written through the driver, a file at a time.
    """
    spark, names = files.sparkSession, []
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = fs.makeQualified(place(path))
    uri = None if whole.toUri().getScheme() == "file" else whole.toUri().toString()
    local = whole.toUri().getPath()

    def store():
        from pyarrow import fs as arrow

        return (arrow.LocalFileSystem(), local) if uri is None else arrow.FileSystem.from_uri(uri)

    def run(batches):
        to, folder = store()
        to.create_dir(folder)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = f".{uuid.uuid4().hex}.part"
                with to.open_output_stream(f"{folder}/{part}") as out:
                    out.write(content.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part])], names=["name", "part"])

    try:
        store()
    except (OSError, ValueError):  # no such store in Arrow, or not on this machine
        for r in files.select("name", "content").toLocalIterator():
            out = fs.create(place(f"{path}/{r.name}"), True)
            out.write(bytearray(r.content))
            out.close()
            names.append(r.name)
        return sorted(names)
    for r in files.select(F.col("name").cast("string"), "content").mapInArrow(run, "name string, part string").collect():  # a row per file
        at = place(f"{path}/{r.name}")
        fs.mkdirs(at.getParent())
        fs.delete(at, False)
        if not fs.rename(place(f"{path}/{r.part}"), at):
            raise OSError(f"{path}/{r.part} could not be renamed to {r.name}")
        names.append(r.name)
    return sorted(names)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """name and sha256 of the bytes of every file below a path, read by the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def without_transient(df: DataFrame) -> DataFrame:
    """Without the columns whose names begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def bounded(batch, column: int, rows: int = 512, most: int = 4 << 20):
    """Slices of an Arrow batch of at most ``rows`` rows and about ``most`` bytes of one text column; one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < batch.num_rows:
        held = sizes[start : start + rows].cumsum()
        n = max(1, int((held <= most).sum()))
        yield batch.slice(start, n)
        start += n
