"""Queries that write tables in a format and read them again, and what goes with files: sources, sinks, features, exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import messages as M
from ..functions import text as X
from ..functions import vectors as V
from ..operators import dedup, sampling, selection
from ..sources import adapters, extract, features, tables
from ..sources.tables import shared_dir, table
from . import pool
from .catalogue import REASONS, TURNS, convs, query, rounded, row

ITEM = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("text", T.StringType())])
WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), "text")


def hashed(df):
    return df.select("item_id", F.md5("text").alias("text_md5"))


def whole(spark, df, path: str, name: str, form: str):
    """One file of all items: a JSON array, or an object that holds one under ``data``."""
    made = F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns))))
    text = made if form == "array" else F.concat(F.lit('{"data":'), made, F.lit("}"))
    tables.write_files(df.agg(text.cast("binary").alias("content")).select(F.lit(name).alias("name"), "content"), path)
    return f"{path}/{name}"


ITEMS_TEXT = "SELECT item_id::VARCHAR AS item_id, md5(text) AS text_md5 FROM benchmark"


# ---- text formats


@query("SELECT doc_id, md5(text) AS text_md5, source FROM documents")
def jsonl_round_trip(spark, d):
    path = shared_dir(spark)
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    tables.write_jsonl(docs, path, "doc_id")
    return tables.read_json(spark, path, docs.schema).select("doc_id", F.md5("text").alias("text_md5"), "source")


@query(" UNION ALL ".join(f"SELECT '{k}' AS form, item_id::VARCHAR AS item_id, md5(text) AS text_md5 FROM benchmark" for k in ("array", "wrapped", "fallback", "object")))
def json_shapes(spark, d):
    """A JSON array, an array below ``data``, an array found by its first line, and one file per object."""
    path, it = shared_dir(spark), items(spark, d)
    array = tables.read_json(spark, whole(spark, it, path, "a.json", "array"), ITEM, lines=False)
    wrapped = tables.read_json(spark, whole(spark, it, path, "w.json", "data"), ITEM, wrapped="data")
    fallback = tables.read_any_json(spark, f"{path}/a.json", ITEM)
    objects = it.select(F.concat(F.lit("o/"), F.md5("item_id"), F.lit(".json")).alias("name"), F.to_json(F.struct("item_id", "text")).cast("binary").alias("content"))
    tables.write_files(objects, path)
    single = tables.read_json(spark, f"{path}/o", ITEM, lines=False)
    out = None
    for form, df in {"array": array, "wrapped": wrapped, "fallback": fallback, "object": single}.items():
        part = hashed(df).select(F.lit(form).alias("form"), "item_id", "text_md5")
        out = part if out is None else out.unionByName(part)
    return out


@query(ITEMS_TEXT)
def gzip_scan(spark, d):
    path = shared_dir(spark)
    items(spark, d).write.option("compression", "gzip").option("ignoreNullFields", False).json(path)
    return hashed(tables.read_json(spark, path, ITEM))


@query("SELECT source, count(*)::BIGINT AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def folder_scan(spark, d):
    """A folder per source, read as one table; the source comes from the path."""
    path = shared_dir(spark)
    docs = table(spark, d, "documents").filter("source IS NOT NULL")
    docs.select("doc_id", "source").repartition("source").write.partitionBy("source").json(path)
    found = tables.read_folder(spark, path, "json", T.StructType.fromDDL("doc_id long"))
    return found.groupBy(F.regexp_extract("_path", "source=([^/]+)", 1).alias("source")).agg(F.count("*").alias("n"))


@query("SELECT item_id % 3 AS shard, count(*)::BIGINT AS n FROM benchmark GROUP BY 1")
def expected_files(spark, d):
    """Three named tables, all of which must be there."""
    path = shared_dir(spark)
    it = table(spark, d, "benchmark")
    names = [f"{path}/{k}" for k in range(3)]
    for k, name in enumerate(names):
        it.filter(F.col("item_id") % 3 == k).write.parquet(name)
    return tables.read_files(spark, names).groupBy((F.col("item_id") % 3).alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT (item_id % 12)::INT AS shard, item_id::VARCHAR AS item_id, md5(text) AS text_md5 FROM benchmark")
def numbered_shards(spark, d):
    """JSON arrays in files 0.json to 11.json, with the number of each row's file."""
    path = shared_dir(spark)
    of = table(spark, d, "benchmark").select((F.col("item_id") % 12).alias("shard"), F.col("item_id").cast("string").alias("item_id"), "text")
    made = of.groupBy("shard").agg(F.to_json(F.collect_list(F.struct("item_id", "text"))).cast("binary").alias("content"))
    tables.write_files(made.select(F.concat(F.col("shard").cast("string"), F.lit(".json")).alias("name"), "content"), path)
    return tables.read_shards(spark, path, ITEM).select(F.col("_shard").alias("shard"), "item_id", F.md5("text").alias("text_md5"))


@query("SELECT (SELECT count(*) FROM documents) AS lines, (SELECT count(*) FROM benchmark) AS elements, 2::BIGINT AS keys")
def record_counts(spark, d):
    path = shared_dir(spark)
    tables.write_jsonl(table(spark, d, "documents").select("doc_id"), f"{path}/lines")
    array = whole(spark, items(spark, d), path, "a.json", "array")
    tables.write_files(spark.createDataFrame([("o.json", bytearray(b'{"a": [1, 2],\n "b": null}'))], "name string, content binary"), path)
    return row(spark, lines=tables.count_records(spark, f"{path}/lines"), elements=int(tables.count_records(spark, array)), keys=int(tables.count_records(spark, f"{path}/o.json")))


@query("SELECT source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM (SELECT DISTINCT source, n_chars FROM documents) GROUP BY 1")
def csv_round_trip(spark, d):
    """Written as CSV, read again, rows once each."""
    path = shared_dir(spark)
    tables.write_csv(table(spark, d, "documents").select("source", "n_chars"), path)
    found = spark.read.option("header", True).schema("source string, n_chars long").csv(path)
    return found.distinct().groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT item_id::VARCHAR || '.txt' AS name, sha256(text) AS sha256 FROM benchmark")
def file_checksums(spark, d):
    path = shared_dir(spark)
    tables.write_files(items(spark, d).select(F.concat("item_id", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content")), path)
    return tables.checksums(spark, path)


@query(f"WITH {REASONS} SELECT reason AS stage, count(*)::BIGINT AS n FROM v WHERE reason IS NOT NULL GROUP BY 1")
def removal_logs(spark, d):
    """A log of removed conversations for each reason, read back as one table."""
    path = shared_dir(spark)
    found = tables.materialize(convs(spark, d).select("conv_id", M.invalid_reason(F.col("messages")).alias("reason")).filter("reason IS NOT NULL"))
    kinds = [r.reason for r in found.select("reason").distinct().collect()]  # a row per reason
    tables.write_removals({k: found.filter(F.col("reason") == k) for k in kinds}, path, "overwrite")
    if not kinds:
        return spark.createDataFrame([], "stage string, n long")
    logs = tables.read_folder(spark, path, "json", T.StructType.fromDDL("conv_id long, reason string"))
    return logs.groupBy(F.regexp_extract("_path", "([^/]+)/[^/]+$", 1).alias("stage")).agg(F.count("*").alias("n"))


# ---- message trees


@query(f"""WITH {TURNS}, r AS (SELECT conv_id, turn, content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
k AS (SELECT * FROM r WHERE i < n - n % 2)
SELECT conv_id::VARCHAR AS tree, md5(string_agg(CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || trim(content), chr(10) ORDER BY turn)) AS path_md5 FROM k GROUP BY conv_id HAVING bool_and(trim(content) <> '')""")
def message_trees(spark, d):
    """Conversations as message trees: each turn the child of the one before it, beside a worse, a rejected and a deleted one."""
    turns = table(spark, d, "conversations").selectExpr("conv_id", "text", "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i")
    copies = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).cast("int").alias("rank"), F.lit(bad).alias("deleted"), F.lit(ok).alias("ok")) for k, r, bad, ok in ((0, 1, False, True), (1, 2, False, True), (2, None, False, True), (3, 0, True, True), (4, 0, False, False))]))
    n = turns.select("*", copies.alias("c")).filter("c.k = 0 OR i > 0")
    name = lambda i, k: F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(i.cast("string"), 6, "0"), k.cast("string"))
    nodes = n.select(
        F.col("conv_id").cast("string").alias("message_tree_id"), name(F.col("i"), F.col("c.k")).alias("message_id"),
        F.when(F.col("i") > 0, name(F.col("i") - 1, F.lit(0))).alias("parent_id"), F.when(F.col("i") % 2 == 0, "prompter").otherwise("assistant").alias("role"),
        F.when(F.col("c.k") == 0, F.col("text")).otherwise(F.lit("other")).alias("text"), F.col("c.rank").alias("rank"), F.col("c.deleted").alias("deleted"),
        F.col("c.ok").alias("review_result"), F.lit("ready_for_export").alias("tree_state"),
    )
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return adapters.best_paths(nodes).select(F.col("message_tree_id").alias("tree"), F.md5(F.array_join(lines, "\n")).alias("path_md5"))


# ---- features of outside tools


def vectors_of(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), (-(1 + (F.col("vec_id") % 17) / 10)).alias("ln_p"))


SUMS = "SELECT vec_id AS doc_id, round(list_sum(embedding::DOUBLE[]), 6) AS total, len(embedding)::INT AS size, round(-(1 + (vec_id % 17) / 10.0::DOUBLE), 6) AS ln_p FROM embeddings"


def summed(c: str):
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


@query(SUMS)
def sqlite_features(spark, d):
    """Vectors written as SQLite files of pickled arrays, and read by the names of their columns."""
    path = shared_dir(spark)
    tables.write_files(features.sqlite_files(vectors_of(spark, d)), path)
    return rounded(features.read_sqlite(spark, path).select("doc_id", summed("embedding").alias("total"), F.size("embedding").alias("size"), "ln_p"))


@query("SELECT 'embedded' AS table_name, 'table' AS kind, unnest(['doc_id', 'embedding', 'ln_p']) AS \"column\", unnest(['INTEGER', 'BLOB', 'REAL']) AS type, count(*)::BIGINT AS rows FROM embeddings")
def sqlite_tables(spark, d):
    """The tables of SQLite files that each hold a part of the vectors, with the rows of all files."""
    path = shared_dir(spark)
    tables.write_files(features.sqlite_files(vectors_of(spark, d), "embedded"), path)
    return features.inspect_sqlite(spark, path).groupBy("table_name", "kind", "column", "type").agg(F.sum("rows").alias("rows"))


@query("SELECT vec_id AS place, vec_id::VARCHAR AS sample_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def npz_features(spark, d):
    """Vectors written as NPZ archives, read, checked against their rows and put in the rows' order."""
    path, e = shared_dir(spark), vectors_of(spark, d).withColumn("sample_id", F.col("doc_id").cast("string"))
    tables.write_files(features.npz_files(e, "sample_id", "embedding"), path)
    got = features.aligned(features.read_npz(spark, path), e.select("sample_id", F.col("doc_id").alias("place")), "sample_id", "place")
    return rounded(got.select("place", "sample_id", summed("value").alias("total")))


@query("SELECT 'missing' AS \"check\", count(*) FILTER (WHERE vec_id % 7 = 0) AS failures FROM embeddings UNION ALL SELECT 'unknown', 1 UNION ALL SELECT 'repeated', count(*) FILTER (WHERE vec_id % 11 = 0 AND vec_id % 7 <> 0) FROM embeddings UNION ALL SELECT 'length', count(*) FILTER (WHERE vec_id % 13 = 0 AND vec_id % 7 <> 0) + count(*) FILTER (WHERE vec_id % 13 = 0 AND vec_id % 11 = 0 AND vec_id % 7 <> 0) FROM embeddings UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE vec_id % 5 = 0 AND vec_id % 7 <> 0) + count(*) FILTER (WHERE vec_id % 5 = 0 AND vec_id % 11 = 0 AND vec_id % 7 <> 0) FROM embeddings")
def feature_checks(spark, d):
    """Vectors with planted faults: what is missing, unknown, repeated, short or not finite is counted."""
    e = vectors_of(spark, d)
    n, x = F.col("doc_id"), F.col("embedding")
    bad = e.filter(n % 7 != 0).withColumn("value", F.when(n % 13 == 0, F.slice(x, 1, F.size(x) - 1)).otherwise(x))
    bad = bad.withColumn("value", F.when(n % 5 == 0, F.transform("value", lambda v, i: F.when(i == 0, F.lit(float("nan"))).otherwise(v))).otherwise(F.col("value"))).select("doc_id", "value")
    bad = bad.union(bad.filter(n % 11 == 0)).union(spark.createDataFrame([(-5, [1.0] * (e.first().embedding.__len__()))], "doc_id long, value array<double>"))
    return features.checked(bad, e, "doc_id")


@query("SELECT item_id, length(text)::BIGINT AS n FROM benchmark")
def pickled_frames(spark, d):
    """Frames pickled by the tasks and read again."""
    path = shared_dir(spark)

    def packed(frames):
        import io
        import uuid

        import pandas as pd

        for f in frames:
            out = io.BytesIO()
            f.to_pickle(out, compression=None)
            yield pd.DataFrame({"name": [uuid.uuid4().hex + ".pkl"], "content": [out.getvalue()]})

    made = table(spark, d, "benchmark").select("item_id", F.length("text").cast("long").alias("n")).mapInPandas(packed, "name string, content binary")
    tables.write_files(made, path)
    return features.read_pickled_frames(spark, path, "item_id long, n long", trusted=True)


@query("SELECT item_id, round(-(item_id + 2) / 2.0::DOUBLE, 6) AS ln_probability FROM benchmark")
def prompt_log_probs(spark, d):
    """The mean log-probability of prompts, without the first token, by a stand-in for an outside model; written as an archive and read."""

    def send():
        return lambda texts: [{"index": i, "ln_probability": extract.mean_log_prob([None, -1.0, -(float(t) + 1)])} for i, t in enumerate(texts)]

    path = shared_dir(spark)
    asked = table(spark, d, "benchmark").select("item_id", F.col("item_id").cast("string").alias("text"))
    tables.write_files(features.npz_files(extract.extract(asked, "item_id", "text", send, "ln_probability", "double"), "item_id", "ln_probability", values="log_probs"), path)
    return rounded(features.read_npz(spark, path, values="log_probs", key="item_id").select(F.col("item_id").cast("long").alias("item_id"), F.col("value")[0].alias("ln_probability")))


# ---- sources joined, validation sets, selections


ADAPTED = f"""{REASONS}, x AS (SELECT 'a::conv::' || conv_id AS sample_id, 'conv' AS source, 0 AS pool FROM v WHERE reason IS NULL
  UNION ALL SELECT 'b::' || substr(sha256('{{"input":"","instruction":' || to_json(trim(instruction)) || ',"output":' || to_json(trim(output)) || '}}'), 1, 16), 'pairs', 1 FROM (
    SELECT a.content AS instruction, b.content AS output FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1) WHERE trim(instruction) <> '' AND trim(output) <> '')"""


def adapted(spark, d):
    """Conversations as pool A, their first exchanges as pool B; invalid rows are left out."""
    turns = M.conversations(table(spark, d, "conversations"))
    a = adapters.chat_rows(turns.select(F.col("conv_id").alias("id"), F.lit("conv").alias("source"), "messages"), "a")
    text = lambda n: F.try_element_at("messages", F.lit(n))["content"]
    b = adapters.instruction_rows(turns.filter(F.size("messages") > 1).select(text(1).alias("instruction"), F.lit("").alias("input"), text(2).alias("output")), "b", "pairs")
    return adapters.original_stream(a, b)


@query(f"WITH {ADAPTED} SELECT pool, source, count(*)::BIGINT AS n FROM x GROUP BY ALL")
def original_stream(spark, d):
    return adapted(spark, d).groupBy("pool", "source").agg(F.count("*").alias("n"))


@query(f"WITH {ADAPTED}, fx AS (SELECT sample_id, source FROM x GROUP BY ALL), sx AS (SELECT sample_id, source, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) AS k FROM fx), cx AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS i FROM sx WHERE k <= 40) SELECT i AS row_index, sample_id, source, true AS messages_alone FROM cx")
def validation_set(spark, d):
    """Forty rows of both pools that no pool holds, exported whole and as messages alone, and read back."""
    path = shared_dir(spark)
    made = pool.validation(adapted(spark, d), 40, 42)
    pool.export_validation(spark, made, path)
    whole_ = spark.read.schema("row_index long, sample_id string, source string").json(f"{path}/canonical")
    alone = spark.read.schema("row_index long, messages array<struct<role:string,content:string>>").json(f"{path}/messages")
    return whole_.join(alone.select("row_index", (F.size("messages") > 0).alias("messages_alone")), "row_index")


@query("WITH g AS (" + " UNION ALL ".join(f"SELECT {g} AS group_id, p::INT AS candidate_index, doc_id FROM (SELECT row_number() OVER (ORDER BY md5('{7 + g}:' || doc_id), doc_id) - 1 AS p, doc_id FROM documents) WHERE p < 20" for g in range(2)) + ") SELECT group_id, candidate_index, doc_id, source FROM g JOIN documents USING (doc_id)")
def selection_export(spark, d):
    """Two samples written in a folder each, and read back with the group from the path."""
    path = shared_dir(spark)
    picked = sampling.hash_groups(table(spark, d, "documents"), 2, 20, "doc_id", 7).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    pool.export_selection(picked.withColumnRenamed("rank", "candidate_index"), path)
    return spark.read.schema("candidate_index int, doc_id long, source string, group_id int").json(path)


NEAR = """o AS (SELECT vec_id, embedding::DOUBLE[] AS v, round((vec_id * 37) % 101 / 10.0::DOUBLE, 6) AS score, row_number() OVER (ORDER BY (vec_id * 37) % 101 DESC, vec_id) AS i FROM embeddings),
x AS MATERIALIZED (SELECT b.i, list(a.vec_id) AS close FROM o a JOIN o b ON a.i < b.i AND list_cosine_similarity(a.v, b.v) > 0.35 GROUP BY b.i),
y AS MATERIALIZED (SELECT o.i, o.vec_id, coalesce(x.close, []) AS close FROM o LEFT JOIN x USING (i)),
s AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT y.i, CASE WHEN list_has_any(s.kept, y.close) OR len(s.kept) = 60 THEN s.kept ELSE list_append(s.kept, y.vec_id) END FROM s JOIN y ON y.i = s.i + 1),
k AS (SELECT unnest(range(len(kept)))::BIGINT AS rank, unnest(kept) AS vec_id FROM s WHERE i = (SELECT max(i) FROM s))"""


@query(f"WITH RECURSIVE {NEAR} SELECT rank, vec_id, label, score FROM k JOIN embeddings USING (vec_id) JOIN o USING (vec_id)")
def selection_pipeline(spark, d):
    """Rows, their scores and their vectors: the best-scored that are not too near to a better one, as whole rows in order."""
    e = table(spark, d, "embeddings")
    judged = e.select("vec_id", F.array((F.col("vec_id") * 37 % 101).cast("double")).alias("quality"), F.array(F.lit(0.1)).alias("complexity"))
    return rounded(selection.pipeline(e.select("vec_id", "label"), judged, e.select("vec_id", "embedding"), "vec_id", ["quality", "complexity"], 0.35, 60).select("rank", "vec_id", "label", "score"))


# ---- text and small operators


@query("SELECT doc_id, md5(coalesce(text, '')) AS key_hex, ('0x' || substr(md5(coalesce(text, '')), 1, 16))::UBIGINT::HUGEINT AS high, ('0x' || substr(md5(coalesce(text, '')), 17, 16))::UBIGINT::HUGEINT AS low FROM documents")
def text_keys(spark, d):
    """md5 of each text, and its 128 bits as two whole numbers."""
    out = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key_hex"))
    high, low = X.hex_halves(F.col("key_hex"))
    return out.select("doc_id", "key_hex", high.alias("high"), low.alias("low"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS text_md5 FROM documents")
def squeezed_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("text_md5"))


@query("SELECT conv_id, md5(trim(string_agg(text, ' ' ORDER BY turn), ' ' || chr(9) || chr(10) || chr(13))) AS doc_md5 FROM conversations GROUP BY 1")
def space_joined(spark, d):
    c = M.conversations(table(spark, d, "conversations"))
    return c.select("conv_id", F.md5(F.regexp_replace(F.array_join(F.transform("messages", lambda m: m["content"]), " "), r"^\s+|\s+$", "")).alias("doc_md5"))


@query(f"SELECT doc_id, len(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]))::BIGINT AS n FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)")
def token_ngram_counts(spark, d):
    """Distinct runs of five tokens, the tokenizer being words between blanks."""
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(X.ngrams(X.words(F.col("text")), 5))).cast("long").alias("n"))


@query(f"SELECT lang AS sem_id, count(*)::BIGINT AS n, round(avg(len({WORDS.format('text')})), 6) AS mean_tokens FROM documents GROUP BY 1")
def class_token_means(spark, d):
    return rounded(table(spark, d, "documents").groupBy(F.col("lang").alias("sem_id")).agg(F.count("*").alias("n"), F.avg(F.size(X.words(F.col("text")))).alias("mean_tokens")))


@query("SELECT label, count(DISTINCT embedding)::BIGINT AS n FROM (SELECT label, embedding FROM embeddings UNION ALL SELECT label, embedding FROM embeddings) GROUP BY 1")
def distinct_vectors(spark, d):
    e = table(spark, d, "embeddings").select("label", "embedding")
    return e.unionByName(e).dropDuplicates(["label", "embedding"]).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])), 6) AS length, round(list_sum([CASE WHEN i = 1 AND vec_id % 3 = 0 THEN 1e-10 ELSE embedding[i]::DOUBLE END FOR i IN range(1, len(embedding) + 1)]), 6) AS repaired FROM embeddings")
def vector_lengths(spark, d):
    """Euclidean lengths, and sums of vectors with a number that is none, put right."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    spoilt = F.transform(x, lambda v, i: F.when((i == 0) & (F.col("vec_id") % 3 == 0), F.lit(float("inf"))).otherwise(v))
    return rounded(table(spark, d, "embeddings").select("vec_id", V.norm(F.col("embedding")).alias("length"), F.aggregate(V.repaired(spoilt), F.lit(0.0), lambda a, v: a + v).alias("repaired")))


@query("SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 64 AS batch FROM documents")
def length_batches(spark, d):
    """Batches of 64 documents of like length."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return sampling.placed(docs, ["n_chars", "doc_id"]).select("doc_id", F.expr("place div 64").alias("batch"))


@query(f"WITH n AS (SELECT label, vec_id % 2 AS half, count(*) AS n FROM embeddings GROUP BY ALL), p AS (SELECT half, n / sum(n) OVER (PARTITION BY half) AS p FROM n) SELECT half::INT AS half, round(-sum(p * ln(p)), 6) AS sem_ent FROM p GROUP BY 1")
def semantic_entropies(spark, d):
    """The natural entropy of the class histograms of two halves."""
    n = table(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 2).cast("int").alias("half")).agg(F.count("*").alias("n"))
    total = n.groupBy("half").agg(F.sum("n").alias("t"))
    p = n.join(total, "half").withColumn("p", F.col("n") / F.col("t"))
    return rounded(p.groupBy("half").agg((-F.sum(F.col("p") * F.log("p"))).alias("sem_ent")))


@query(f"WITH {TURNS}, n AS (SELECT conv_id, turn, role, len({WORDS.format('content')}) + 1 AS n FROM t), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM n) SELECT conv_id, (e - n)::BIGINT AS start, e::BIGINT AS \"end\" FROM s WHERE role <> 'assistant' OR role IS NULL")
def scorer_masked_spans(spark, d):
    """Token spans that a scorer's training masks: all but answers, by lengths of the prompt so far; a sign of the role's own per turn."""
    spans = M.token_spans(F.col("messages"), lambda c: F.size(X.words(c)) + 1)
    return convs(spark, d).select("conv_id", F.explode(spans).alias("s")).filter("s.masked").select("conv_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query(f"SELECT item_id, [x FOR x IN ['the', 'and', 'of', 'de'] IF list_contains(w, x)] AS names, [len([y FOR y IN w IF y = x])::BIGINT FOR x IN ['the', 'and', 'of', 'de'] IF list_contains(w, x)] AS counts FROM (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark)")
def example_features(spark, d):
    """Counts of given words attached to each item as named features."""
    w = X.words(F.col("text"))
    asked = F.array(*map(F.lit, ("the", "and", "of", "de")))
    return table(spark, d, "benchmark").select("item_id", w.alias("w")).select("item_id", F.filter(asked, lambda x: F.array_contains("w", x)).alias("names")).join(
        table(spark, d, "benchmark").select("item_id", F.transform(F.filter(asked, lambda x: F.array_contains(w, x)), lambda x: F.size(F.filter(w, lambda y: y == x)).cast("long")).alias("counts")), "item_id")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY n_chars DESC, doc_id) = 1")
def priority_first(spark, d):
    """Of each source the row of highest priority."""
    return dedup.first_by(table(spark, d, "documents"), ["source"], [F.desc("n_chars"), "doc_id"]).select("source", "doc_id")
