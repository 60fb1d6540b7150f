"""Token counts: rollups by source, language and tokenizer version, maintained by deltas.

A batch of changes (insert, delete, revise) is turned into signed rows: what a document counted so far is
retracted, what it counts now is added. The signed rows of a commit are one Parquet table below
``deltas/<sequence>-<batch>``, dealt by bucket of doc_id; its ``_SUCCESS`` file is the commit. Commits are numbered
in the order in which they happen, whatever the ids of their batches, and history follows that number. A batch that
was committed is never applied again; one that was cut short left no ``_SUCCESS`` and is written anew.

Totals are sums of signed rows by key, so they only ever add. After every ``compact_after`` commits the current
counts (one row per document and version) and the totals are written as a table of their own, ``states/<sequence>`` and
``totals/<sequence>``; later commits read that state and the deltas after it, and of those only the buckets that
their changes touch. One writer at a time.

Inserting or revising a document that counts already replaces its count; deleting one that does not is
nothing. Within a batch the last change of a document and version holds (by ``seq``, then the count), so repeated rows
count once. Null sources and languages are keys of their own, as are null doc_ids and versions; null counts are 0, and a
null ``op`` is a revision. Empty batches commit. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["source", "lang", "tokenizer_version"]
SIGNED = "doc_id long, tokenizer_version string, source string, lang string, n_tokens long, sign int, sequence long, bucket int"
SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
NAMES = [c.split()[0] for c in SIGNED.split(", ")]


def sums(rows: DataFrame) -> DataFrame:
    """Additive totals of signed rows."""
    return rows.groupBy(*KEY).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))


class TokenRollup:
    """Totals kept below ``path``, a folder every executor reaches. ``buckets`` is fixed when the first batch is committed: each is one task at most, and a run of rows in one file of a table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, compact_after: int = 16):
        self.spark, self.path, self.buckets, self.compact_after = spark, path.rstrip("/"), buckets, compact_after

    def _done(self, kind: str) -> list[str]:
        """Names of the finished tables of a kind, oldest first, from one listing."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted((f.getPath().getParent().getName() for f in found), key=lambda n: int(n.split("-")[0]))

    def commits(self) -> dict[int, int]:
        """Sequence number of each committed batch."""
        return {int(batch): int(n) for n, batch in (name.split("-", 1) for name in self._done("deltas"))}

    def batches(self) -> list[int]:
        """Committed batches in the order of their commits."""
        return list(self.commits())

    def _tables(self, commits: dict[int, int]) -> tuple[int, list[str]]:
        """The sequence number of the last compaction (0 for none) and the deltas after it."""
        last = int(([n for n in self._done("totals")] or ["0"])[-1])  # written after its state
        return last, [f"{self.path}/deltas/{n}-{b}" for b, n in commits.items() if n > last]

    def _signed(self, commits: dict[int, int]) -> DataFrame | None:
        """The last compacted state, as additions, and all signed rows after it."""
        last, later = self._tables(commits)
        paths = [f"{self.path}/states/{last}"] * (last > 0) + later
        parts = [self.spark.read.schema(SIGNED).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _current(self, signed: DataFrame) -> DataFrame:
        """What each document and version counts: its last row in the order of commits, an addition after a retraction."""
        key = ["bucket", "doc_id", "tokenizer_version"]
        last = signed.repartition("bucket").groupBy(*key).agg(F.max_by(F.struct("source", "lang", "n_tokens", "sign", "sequence"), F.struct("sequence", "sign")).alias("o"))
        return last.filter("o.sign > 0").select(*key, "o.source", "o.lang", "o.n_tokens", "o.sequence")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies changes (doc_id, tokenizer_version, source, lang, n_tokens, op, optionally seq) once; False if it was applied before."""
        done = self.commits()
        if batch in done:
            return False
        number = max(done.values(), default=0) + 1
        seq = "seq" if "seq" in changes.columns else F.lit(0).alias("seq")
        key = ["doc_id", "tokenizer_version"]
        change = F.struct(seq, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.coalesce("op", F.lit("revise")).alias("op"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang")))
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        rows = changes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokenizer_version").cast("string").alias("tokenizer_version"), change.alias("c"), bucket).repartition("bucket")
        new = rows.groupBy("bucket", *key).agg(F.max("c").alias("c")).select(*key, "c.*", "bucket")  # dealt by bucket already
        rows = new.filter("op <> 'delete'").select(*key, "source", "lang", "n_tokens", F.lit(1).alias("sign"), "bucket")
        signed = self._signed(done)
        if signed is not None:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # ``buckets`` rows at most
            old = self._current(signed.filter(F.col("bucket").isin(touched))).alias("o")
            asked = new.select(*key, "bucket").alias("a")
            same = (F.col("o.bucket") == F.col("a.bucket")) & F.col("o.doc_id").eqNullSafe(F.col("a.doc_id")) & F.col("o.tokenizer_version").eqNullSafe(F.col("a.tokenizer_version"))
            gone = old.join(asked, same, "left_semi")
            rows = rows.unionByName(gone.select(*key, "source", "lang", "n_tokens", F.lit(-1).alias("sign"), "bucket"))
        self._write(rows.withColumn("sequence", F.lit(number).cast("long")), f"deltas/{number}-{batch}")
        if number % self.compact_after == 0:
            self.compact()
        return True

    def _write(self, rows: DataFrame, name: str) -> None:
        """A table of signed rows, dealt and sorted by bucket: the statistics of its files let commits read only the buckets they touch."""
        rows.select(*NAMES).repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{self.path}/{name}")

    def compact(self) -> None:
        """Writes the current counts and the totals of all commits so far; the deltas stay as history."""
        done = self.commits()
        number = max(done.values(), default=0)
        if number and str(number) not in self._done("totals"):
            self._write(self._current(self._signed(done)).withColumn("sign", F.lit(1)), f"states/{number}")
            self._totals(done).write.mode("overwrite").parquet(f"{self.path}/totals/{number}")

    def _totals(self, commits: dict[int, int]) -> DataFrame:
        last, later = self._tables(commits)
        parts = [self.spark.read.schema(SUMS).parquet(f"{self.path}/totals/{last}")] if last else []
        parts += [sums(self.spark.read.schema(SIGNED).parquet(p)) for p in later]
        if not parts:
            return self.spark.createDataFrame([], SUMS)
        return reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs and n_tokens of the committed batches; keys without documents are left out."""
        return self._totals(self.commits()).filter("n_docs <> 0")
