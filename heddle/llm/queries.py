"""Thin queries over the driver's tables, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parity_join, quality_knn, quality_rules, rank_langid, secret_cnn, sentencepiece_codec, source_mix, telephony, token_rollup, warc_records, warc_revisit
from .shared import materialize, shared_dir, table, trained_on


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, piece_model()).drop("text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizer versions inserted, every fifth document revised (an end token more), every eleventh deleted; one batch sent twice."""
    count = lambda p: F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", count(r"[^\x20\x09-\x0D]+").alias("w"), count(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]").alias("s"))
    docs = materialize(docs)
    change = lambda df, version, n, op: df.select("doc_id", F.lit(version).alias("tokenizer_version"), "source", "lang", n.alias("n_tokens"), F.lit(op).alias("op"))
    rollup = token_rollup.TokenRollup(spark, shared_dir(spark), buckets=16, compact_after=3)
    fifth, eleventh = docs.filter("doc_id % 5 = 0"), docs.filter("doc_id % 11 = 0")
    signs = change(docs, "signs-1", F.col("s"), "insert")
    rollup.commit(0, change(docs, "words-1", F.col("w"), "insert"))
    rollup.commit(1, signs)
    rollup.commit(2, change(fifth, "words-1", F.col("w") + 1, "revise"))
    rollup.commit(3, change(eleventh, "words-1", F.col("w"), "delete").union(change(eleventh, "signs-1", F.col("s"), "delete")))
    rollup.commit(1, signs)
    return rollup.totals()


OP2 = r"""
WITH d AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
  len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]')) AS s FROM documents WHERE doc_id % 11 <> 0)
SELECT source, lang, 'words-1' AS tokenizer_version, count(*)::BIGINT AS n_docs, sum(w + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_tokens FROM d GROUP BY ALL
UNION ALL SELECT source, lang, 'signs-1', count(*)::BIGINT, sum(s)::BIGINT FROM d GROUP BY ALL"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.learn(docs, table(spark, sf_dir, "labels"))
    return quality_knn.score(docs.withColumn("held_out", ~trained_on(F.col("doc_id"))), model).drop("text")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.link_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The WAVE files are written to the shared folder as a column, and read back from there."""
    stored = materialize(telephony.store(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return telephony.digests(telephony.read_back(stored))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = rank_langid.learn(docs)
    return rank_langid.predict(docs.select("doc_id", "text", (~trained_on(F.col("doc_id"))).alias("held_out")), model).drop("text")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def crawl(pages: DataFrame) -> DataFrame:
    """WARC records of ``pages``: a response each, a revisit before it without validators and one after it, whose tag differs for every third page."""
    body = F.coalesce("html", F.lit(""))
    tag = F.md5(body)
    p = pages.select("page_id", "url", tag.alias("tag"), F.length(body).cast("string").alias("len"), body.cast("binary").alias("body"))
    lit, ts = F.lit, lambda n: F.col("page_id") * 10 + n
    head = lambda *kv: F.create_map(*[x if not isinstance(x, str) else lit(x) for x in kv])
    row = lambda k, n, kind, status, headers, body: F.struct(F.concat(lit("urn:page:"), (F.col("page_id") * 4 + k).cast("string")).alias("record_id"), "url", ts(n).alias("ts"), lit(kind).alias("kind"), lit(None if kind == "response" else warc_records.NOT_MODIFIED).cast("string").alias("profile"), lit(status).alias("status"), headers.alias("headers"), body.alias("body"))
    date = lambda n: ts(n).cast("string")
    new = F.when(F.col("page_id") % 3 == 0, F.concat("tag", lit("x"))).otherwise(F.concat(lit("W/"), "tag"))
    nothing = lit(None).cast("binary")
    rows = F.array(
        row(0, 0, "response", 200, head("content-type", "text/html", "content-length", F.col("len"), "date", date(0), "etag", F.col("tag")), F.col("body")),
        row(1, 5, "revisit", 304, head("cache-control", "max-age=60", "content-length", "0", "date", date(5), "etag", new), nothing),
        row(2, -1, "revisit", 304, head("content-length", "0", "date", date(-1)), nothing),
    )
    return warc_records.written(p.select(F.explode(rows).alias("r")).select("r.*")).select("content")


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of ``pages``, written as WARC records and parsed from their bytes."""
    records = materialize(warc_records.parsed(crawl(table(spark, sf_dir, "pages").select("page_id", "url", "html"))))
    number = F.regexp_extract("record_id", "[0-9]+$", 0).cast("long")
    out = warc_revisit.resolve(records.withColumn("record_id", number))
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.withColumn("headers", F.array_join(entries, ";"))


OP8 = r"""
WITH u AS (SELECT page_id, md5(coalesce(html, '')) AS tag, length(coalesce(html, '')) AS n, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
h AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS h0, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS r0 FROM u),
c AS (SELECT page_id, tag, n, regexp_replace(regexp_replace(h0, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') ||
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(r0, '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '([?&])&+', '\1', 'g'), '[?&]+$', ''), '/$', '') AS curl FROM h),
r AS (SELECT page_id * 4 AS response_id, page_id * 10 AS response_ts, curl, tag, n FROM c),
v AS (SELECT page_id * 4 + 1 AS record_id, curl, page_id * 10 + 5 AS ts, CASE WHEN page_id % 3 = 0 THEN tag || 'x' ELSE 'W/' || tag END AS etag FROM c
  UNION ALL SELECT page_id * 4 + 2, curl, page_id * 10 - 1, NULL FROM c),
j AS (SELECT v.*, r.response_id, r.response_ts, r.tag, r.n FROM v ASOF LEFT JOIN r ON v.curl = r.curl AND v.ts > r.response_ts),
s AS (SELECT *, CASE WHEN response_id IS NULL THEN 'unresolved' WHEN etag IS NULL THEN 'unchecked' WHEN regexp_replace(etag, '^W/', '') = tag THEN 'confirmed' ELSE 'changed' END AS status FROM j)
SELECT record_id::BIGINT AS record_id, curl AS canonical_url, ts::BIGINT AS ts, response_id::BIGINT AS response_id, response_ts::BIGINT AS response_ts, status,
  CASE WHEN etag IS NULL THEN '' ELSE 'cache-control=max-age=60;' END ||
  'content-length=' || CASE WHEN status IN ('confirmed', 'unchecked') THEN n::VARCHAR ELSE '0' END ||
  CASE WHEN status IN ('confirmed', 'unchecked') THEN ';content-type=text/html' ELSE '' END || ';date=' || ts::VARCHAR ||
  CASE WHEN etag IS NOT NULL THEN ';etag=' || etag WHEN status = 'unchecked' THEN ';etag=' || tag ELSE '' END AS headers FROM s"""


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_cnn.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_token_counts, op3_quality, op4_jaccard, op5_media, op6_language, op7_mix, op8_revisits, op9_rules, op10_secrets, pipeline)
}
ORACLE = {"op2_token_counts": OP2, "op7_mix": source_mix.ORACLE, "op8_revisits": OP8, "op9_rules": quality_rules.oracle_sql()}
