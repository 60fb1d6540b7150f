"""Queries over the driver's tables and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import text as X
from ..functions import vectors as V
from ..operators import cohesion, dedup, geometric, kernel, lexical, sampling, selection
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def row(spark: SparkSession, **values) -> DataFrame:
    kinds = {int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


# ---- semantic classes


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("sem_id"), (-(1 + (F.col("vec_id") % 17) / 10)).alias("ln_p"), "embedding")


FEATURES = """
e AS (SELECT vec_id AS doc_id, label AS sem_id, -(1 + (vec_id % 17) / 10.0::DOUBLE) AS ln_p, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT sem_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
c AS (SELECT sem_id, list(m ORDER BY i) AS c FROM (SELECT sem_id, i, avg(x) AS m FROM u GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT e.*, list_distance(v, c) AS dist FROM e JOIN c USING (sem_id)),
w AS (SELECT *, exp(-dist) / sum(exp(-dist)) OVER (PARTITION BY sem_id) AS w FROM d),
m AS (SELECT sem_id, count(*)::BIGINT AS n, sum(exp(ln_p)) AS g, count(*) * sum(exp(ln_p) * w) AS c FROM w GROUP BY 1),
q AS (SELECT sem_id, n, n / sum(n) OVER () AS p_count, g / sum(g) OVER () AS p_generation, c / sum(c) OVER () AS p_cohesion FROM m)"""


@query(f"WITH {FEATURES} SELECT round(-sum(p_cohesion * ln(p_cohesion)), 6) AS cohesion_entropy, round(-sum(p_generation * ln(p_generation)), 6) AS generation_entropy, round(-sum(p_count * ln(p_count)), 6) AS count_entropy FROM q")
def cohesion_entropy(spark, d):
    return rounded(cohesion.entropies(features(spark, d)))


@query(f"WITH {FEATURES} SELECT sem_id, n, round(p_count, 6) AS p_count, round(p_generation, 6) AS p_generation, round(p_cohesion, 6) AS p_cohesion FROM q")
def class_report(spark, d):
    return rounded(cohesion.class_report(features(spark, d)))


@query(f"WITH {FEATURES} SELECT doc_id, sem_id, round(w, 8) AS w FROM w")
def cohesion_weights(spark, d):
    return rounded(cohesion.weights(features(spark, d)).select("doc_id", "sem_id", "w"), 8)


@query(f"WITH {FEATURES}, r AS (SELECT doc_id, sem_id, row_number() OVER (PARTITION BY sem_id ORDER BY w DESC, doc_id) AS round FROM w) SELECT doc_id, sem_id, round FROM r ORDER BY round, sem_id LIMIT 100")
def cohesion_round_robin(spark, d):
    return cohesion.round_robin(cohesion.weights(features(spark, d)), 100).select("doc_id", "sem_id", F.col("round").cast("long"))


@query("SELECT round(-sum(p * log2(p)), 6) AS partition_entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY label)")
def partition_entropy(spark, d):
    return rounded(kernel.partition_entropy(table(spark, d, "embeddings"), "label"))


@query(f"WITH {FEATURES} SELECT round(sum(dist * dist), 4) AS inertia FROM d")
def class_inertia(spark, d):
    return rounded(geometric.inertia(table(spark, d, "embeddings"), "label"), 4)


@query(f"WITH {FEATURES}, a AS (SELECT doc_id, c.sem_id AS near, list_distance(v, c) AS dist FROM e, c), b AS (SELECT doc_id, arg_min(near, dist) AS near FROM a GROUP BY 1) SELECT near, count(*)::BIGINT AS n FROM b GROUP BY 1")
def nearest_centroid_histogram(spark, d):
    e = features(spark, d)
    c = V.centroids(e, "sem_id", "embedding").agg(F.collect_list(F.struct("sem_id", "centroid")).alias("cs"))  # a row per class
    best = F.array_min(F.transform("cs", lambda s: F.struct(V.euclidean(F.col("embedding"), s["centroid"]).alias("far"), s["sem_id"].alias("near"))))
    return e.join(F.broadcast(c)).select(best["near"].alias("near")).groupBy("near").agg(F.count("*").alias("n"))


# ---- conversations


def convs(spark: SparkSession, d: str) -> DataFrame:
    return M.conversations(table(spark, d, "conversations")).withColumn("messages", M.normalized(F.col("messages")))


ROLES = "CASE lower(trim(role)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in M.ALIASES.items()) + " END"
TURNS = f"t AS (SELECT conv_id, turn, {ROLES} AS role, text AS content FROM conversations)"
REASONS = f"""{TURNS},
b AS (SELECT *, max(CASE WHEN role IN ('user', 'assistant') THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt FROM t),
f AS (SELECT b.*, p.role AS before FROM b LEFT JOIN t p ON p.conv_id = b.conv_id AND p.turn = b.lt),
g AS (SELECT *, CASE WHEN role = 'system' AND before IS NOT NULL THEN 'system_not_at_prefix' WHEN role = 'assistant' AND trim(content) = '' THEN 'empty_assistant'
  WHEN role = 'assistant' AND before = 'assistant' THEN 'assistant_not_alternating' WHEN role = 'user' AND before = 'user' THEN 'user_not_alternating' END AS fault FROM f),
a AS (SELECT conv_id, arg_min(fault, turn) FILTER (WHERE fault IS NOT NULL) AS fault, coalesce(arg_min(role, turn) FILTER (WHERE role <> 'system'), '') AS first, arg_max(role, turn) AS last,
  bool_or(role IS NULL) AS bad, bool_or(role = 'assistant') AS has FROM g GROUP BY 1),
v AS (SELECT conv_id, CASE WHEN bad THEN 'invalid_role' WHEN first <> 'user' THEN 'first_non_system_not_user' WHEN last <> 'assistant' THEN 'last_role_not_assistant' WHEN fault IS NOT NULL THEN fault WHEN NOT has THEN 'no_assistant' END AS reason FROM a)"""


@query(f"WITH {TURNS} SELECT role, count(*)::BIGINT AS n FROM t GROUP BY 1")
def role_distribution(spark, d):
    return table(spark, d, "conversations").groupBy(M.role(F.col("role")).alias("role")).agg(F.count("*").alias("n"))


@query(f"WITH {REASONS} SELECT conv_id, reason FROM v")
def validate_messages(spark, d):
    return convs(spark, d).select("conv_id", M.invalid_reason(F.col("messages")).alias("reason"))


@query(f"WITH {REASONS} SELECT coalesce(reason, 'valid') AS reason, count(*)::BIGINT AS n FROM v GROUP BY 1")
def validation_reason_counts(spark, d):
    return validate_messages(spark, d).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {TURNS} SELECT conv_id, md5(string_agg('[' || upper(role) || ']' || chr(10) || trim(content), chr(10) || chr(10) || '<TURN_END>' || chr(10) || chr(10) ORDER BY turn)) AS doc_md5 FROM t GROUP BY 1")
def build_docs(spark, d):
    return convs(spark, d).select("conv_id", F.md5(M.document(F.col("messages"))).alias("doc_md5"))


@query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS doc_md5, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1")
def flat_docs(spark, d):
    c = M.conversations(table(spark, d, "conversations")).select("conv_id", M.flat(F.col("messages")).alias("doc"))
    return c.select("conv_id", F.md5("doc").alias("doc_md5"), F.length("doc").cast("long").alias("n_chars"))


@query(f"WITH {TURNS} SELECT conv_id, coalesce(arg_min(content, turn) FILTER (WHERE role = 'user'), '') AS prompt FROM t GROUP BY 1")
def first_user_prompt(spark, d):
    return convs(spark, d).select("conv_id", M.first_user_prompt(F.col("messages")).alias("prompt"))


@query(f"WITH {TURNS}, k AS (SELECT conv_id, list({{'r': role, 'c': content}} ORDER BY turn) AS m FROM t GROUP BY 1) SELECT min(conv_id)::BIGINT AS conv_id, count(*)::BIGINT AS copies FROM k GROUP BY m")
def message_key_dedup(spark, d):
    return convs(spark, d).groupBy(M.key(F.col("messages")).alias("k")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")).drop("k")


@query("WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT a.conv_id, (a.i // 2)::BIGINT AS pair, a.text AS instruction, coalesce(b.text, '') AS response FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.i = a.i + 1 WHERE a.i % 2 = 0")
def instruction_response_pairs(spark, d):
    c = M.conversations(table(spark, d, "conversations"))
    return c.select("conv_id", F.posexplode(M.pairs(F.col("messages"))).alias("pair", "p")).select("conv_id", F.col("pair").cast("long").alias("pair"), "p.instruction", "p.response")


SQL_WORDS = r"len(regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+'))"
LENGTHS = f"{TURNS}, n AS (SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN {SQL_WORDS.format('content')} ELSE 0 END)::BIGINT AS response, sum(CASE WHEN role = 'assistant' THEN 0 ELSE {SQL_WORDS.format('content')} END)::BIGINT AS prompt FROM t GROUP BY 1)"


def lengths(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(X.words(F.col("text")))
    return table(spark, d, "conversations").withColumn("r", M.role(F.col("role")) == "assistant").groupBy("conv_id").agg(F.sum(F.when(F.col("r"), n).otherwise(0)).alias("response"), F.sum(F.when(F.col("r"), 0).otherwise(n)).alias("prompt"))


@query(f"WITH {LENGTHS} SELECT conv_id, prompt, response, prompt + response AS total FROM n")
def conversation_lengths(spark, d):
    return lengths(spark, d).select("conv_id", "prompt", "response", (F.col("prompt") + F.col("response")).alias("total"))


@query(f"""WITH {LENGTHS}, x AS (SELECT 'prompt' AS part, prompt AS n FROM n UNION ALL SELECT 'response', response FROM n UNION ALL SELECT 'total', prompt + response FROM n)
SELECT part, count(*)::BIGINT AS rows, min(n)::BIGINT AS least, max(n)::BIGINT AS most, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99 FROM x GROUP BY 1""")
def length_audit(spark, d):
    n = lengths(spark, d)
    x = n.select(F.explode(F.create_map(F.lit("prompt"), "prompt", F.lit("response"), "response", F.lit("total"), F.col("prompt") + F.col("response"))).alias("part", "n"))
    q = F.percentile("n", F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    a = x.groupBy("part").agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), q.alias("q"))
    return rounded(a.select("part", "rows", "least", "most", "mean", *[F.col("q")[i].alias(p) for i, p in enumerate(("p50", "p90", "p95", "p99"))]))


@query(f"WITH {LENGTHS} SELECT round(sum(response) / sum(prompt + response), 6) AS pooled_ratio, round(avg(response / (prompt + response)), 6) AS mean_ratio, count(*)::BIGINT AS rows FROM n WHERE prompt + response > 0")
def prompt_response_ratio(spark, d):
    n = lengths(spark, d).withColumn("total", F.col("prompt") + F.col("response")).filter("total > 0")
    return rounded(n.agg((F.sum("response") / F.sum("total")).alias("pooled_ratio"), F.avg(F.col("response") / F.col("total")).alias("mean_ratio"), F.count("*").alias("rows")))


@query(f"WITH {TURNS}, s AS (SELECT *, sum(length(content)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM t) SELECT conv_id, (e - length(content))::BIGINT AS start, e::BIGINT AS \"end\" FROM s WHERE role = 'assistant'")
def sft_trained_spans(spark, d):
    return convs(spark, d).select("conv_id", F.explode(M.sft_spans(F.col("messages"))).alias("s")).filter("s.trained").select("conv_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query(f"WITH {TURNS} SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>', chr(10) ORDER BY turn)) AS prompt_md5 FROM t GROUP BY 1")
def rendered_prompts(spark, d):
    return convs(spark, d).select("conv_id", F.md5(M.rendered(F.col("messages"))).alias("prompt_md5"))


# ---- documents


@query("SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def source_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1")
def language_distribution(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("""SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(text, chr(64257), 'fi'), chr(178), '2'), chr(12288), ' '), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), ' ' || chr(9) || chr(10) || chr(160))) AS text_md5 FROM documents""")
def clean_text(spark, d):
    """Of texts with compatibility characters, line ends of three kinds, control characters and white space put in; cleaning undoes them."""
    lines = F.regexp_replace("text", "\n", "\r\n")
    messy = F.concat(F.lit(" \u00a0\t\x07\r"), F.regexp_replace(lines, "([aeiou])", "$1\x01"), F.lit("\x7f\x0b\u3000\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean(F.when(F.col("text").isNotNull(), messy))).alias("text_md5"))


FIRSTS = "f AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY coalesce(text, '') ORDER BY source, doc_id) AS matched_id FROM documents)"


@query(f"WITH {FIRSTS} SELECT doc_id FROM f WHERE doc_id = matched_id")
def exact_dedup_kept(spark, d):
    return dedup.exact(table(spark, d, "documents"), "text", ["source"], "doc_id")[0].select("doc_id")


@query(f"WITH {FIRSTS} SELECT doc_id, matched_id FROM f WHERE doc_id <> matched_id")
def exact_dedup_removed(spark, d):
    return dedup.exact(table(spark, d, "documents"), "text", ["source"], "doc_id")[1].select("doc_id", "matched_id")


@query("SELECT doc_id FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM benchmark)")
def hash_decontamination(spark, d):
    return dedup.without_contamination(table(spark, d, "documents"), "text", table(spark, d, "benchmark"), "text").select("doc_id")


@query("SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def exclusion_anti_join(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("WITH g AS (SELECT doc_id, substr(text, i, 5) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 3)) AS i FROM documents WHERE length(text) >= 5)) SELECT d.doc_id, count(DISTINCT g.g)::BIGINT AS n FROM documents d LEFT JOIN g USING (doc_id) GROUP BY 1")
def char_ngram_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.char_ngram_count(F.col("text"), 5).alias("n"))


@query("SELECT item_id, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT AS h FROM (SELECT item_id, sha1(text) AS h FROM benchmark)")
def base_hashes(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.base_hash(F.col("text")).alias("h"))


#: Pairs of texts with a similarity of 0.8 by 5-character windows: two such sets share one of their rarest fifth (and one more) windows.
SIMILAR = """
t AS (SELECT doc_id, coalesce(text, '') AS text, source, row_number() OVER (ORDER BY source, doc_id) AS i FROM documents),
x AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text ORDER BY i) AS first FROM t),
g AS MATERIALIZED (SELECT DISTINCT i, substr(text, p, 5) AS g FROM (SELECT i, text, unnest(range(1, length(text) - 3)) AS p FROM x WHERE doc_id = first AND length(text) >= 5)),
n AS MATERIALIZED (SELECT i, count(*) AS n FROM g GROUP BY 1),
k AS MATERIALIZED (SELECT i, g, n, row_number() OVER (PARTITION BY i ORDER BY f, g) AS k FROM g JOIN (SELECT g, count(*) AS f FROM g GROUP BY 1) USING (g) JOIN n USING (i)),
c AS MATERIALIZED (SELECT DISTINCT a.i AS a, b.i AS b, a.n AS na, b.n AS nb FROM k a JOIN k b USING (g) WHERE a.i < b.i AND a.k <= a.n * 0.2 + 1 AND b.k <= b.n * 0.2 + 1 AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
j AS (SELECT a, b, count(*) / (any_value(na) + any_value(nb) - count(*)) AS s FROM c JOIN g x ON x.i = c.a JOIN g y ON y.i = c.b AND y.g = x.g GROUP BY 1, 2
  UNION ALL SELECT a.i, b.i, 1.0 FROM x a JOIN x b ON a.i < b.i AND length(a.text) < 5 AND length(b.text) < 5 AND a.doc_id = a.first AND b.doc_id = b.first),
l AS MATERIALIZED (SELECT * FROM j WHERE s >= 0.8),
o AS MATERIALIZED (SELECT b AS i, list(a) AS close, row_number() OVER (ORDER BY b) AS step FROM l GROUP BY b),
r AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS gone UNION ALL
  SELECT o.step, CASE WHEN len([z FOR z IN o.close IF NOT list_contains(r.gone, z)]) > 0 THEN list_append(r.gone, o.i) ELSE r.gone END FROM r JOIN o ON o.step = r.step + 1),
e AS (SELECT unnest(gone) AS i FROM r WHERE step = (SELECT max(step) FROM r)),
m AS (SELECT l.b AS i, arg_min(t.doc_id, {'s': -l.s, 'i': l.a}) AS matched_id, round(max(l.s), 6) AS similarity FROM l JOIN e ON e.i = l.b JOIN t ON t.i = l.a WHERE l.a NOT IN (SELECT i FROM e) GROUP BY 1)"""


@query(f"WITH RECURSIVE {SIMILAR} SELECT doc_id, doc_id = first AND m.i IS NULL AS kept, CASE WHEN doc_id <> first THEN first ELSE m.matched_id END AS matched_id, CASE WHEN doc_id <> first THEN 1.0 ELSE m.similarity END AS similarity FROM x LEFT JOIN m USING (i)")
def minhash_keep_first(spark, d):
    return dedup.near(table(spark, d, "documents"), "doc_id", "text", ["source"])


QUOTA = """
c AS (SELECT source, count(*) AS n, least(count(*), 2) AS base FROM documents GROUP BY 1),
t AS (SELECT *, n - base AS spare, sqrt(n - base) AS width, (SELECT sum(n) // 2 - sum(least(n, 2)) FROM c) AS water FROM c),
o AS (SELECT *, (water - coalesce(sum(spare) OVER (ORDER BY spare, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(width) OVER (ORDER BY spare, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t),
l AS (SELECT *, (SELECT level FROM o WHERE level <= width ORDER BY spare, source LIMIT 1) AS lv FROM o),
s AS (SELECT *, least(spare, lv * width) AS share, floor(least(spare, lv * width) + 1e-9) AS whole FROM l),
r AS (SELECT *, row_number() OVER (ORDER BY base + whole < n DESC, round(whole - share, 9), source) AS place, water - sum(whole) OVER () AS single FROM s)"""


@query(f"WITH {QUOTA} SELECT source, (base + whole + CASE WHEN base + whole < n AND place <= single THEN 1 ELSE 0 END)::BIGINT AS quota FROM r")
def source_quota(spark, d):
    counts = {r.source: r.n for r in source_counts(spark, d).collect()}  # a row per source
    return spark.createDataFrame(list(sampling.source_quotas(counts, sum(counts.values()) // 2, base=2).items()), "source string, quota long")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) <= 10")
def quota_sample(spark, d):
    docs = table(spark, d, "documents")
    return sampling.quota_sample(docs, {r.source: 10 for r in source_counts(spark, d).collect()}, "doc_id", seed=42).select("doc_id", "source")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id::VARCHAR), doc_id LIMIT 100")
def hash_topk_sample(spark, d):
    return sampling.hash_sample(table(spark, d, "documents"), 100, "doc_id", 7).select("doc_id")


def _groups(disjoint: bool) -> str:
    """SQL of three groups of 50 documents by hash order."""
    ranked = lambda g: f"SELECT row_number() OVER (ORDER BY md5('{123 + g}:' || doc_id), doc_id) - 1 AS p, doc_id FROM documents"
    if disjoint:
        return f"SELECT (p // 50)::INT AS group_id, (p % 50)::INT AS rank, doc_id FROM ({ranked(0)}) WHERE p < 150"
    return " UNION ALL ".join(f"SELECT {g} AS group_id, p::INT AS rank, doc_id FROM ({ranked(g)}) WHERE p < 50" for g in range(3))


@query(_groups(False))
def random_groups(spark, d):
    return sampling.hash_groups(table(spark, d, "documents"), 3, 50, "doc_id", 123)


@query(_groups(True))
def disjoint_groups(spark, d):
    return sampling.hash_groups(table(spark, d, "documents"), 3, 50, "doc_id", 123, disjoint=True)


@query(f"WITH g AS ({_groups(False)}) SELECT a.group_id AS g1, b.group_id AS g2, count(*)::BIGINT AS shared FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.group_id < b.group_id GROUP BY 1, 2")
def group_overlaps(spark, d):
    return sampling.overlaps(random_groups(spark, d), "doc_id")


@query("SELECT doc_id FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM benchmark) ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def reservoir_validation(spark, d):
    """A fixed number of rows without replacement among those that are not in the benchmark."""
    rows = dedup.without_contamination(table(spark, d, "documents"), "text", table(spark, d, "benchmark"), "text")
    return sampling.hash_sample(rows, 100, "doc_id", 42).select("doc_id")


@query("SELECT d.doc_id, row_number() OVER (ORDER BY round(l.quality * ln(1 + d.n_chars), 6) DESC, d.doc_id) AS rank, round(l.quality * ln(1 + d.n_chars), 6) AS score FROM documents d JOIN labels l USING (doc_id)")
def score_first_rank(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    scored = rows.select("doc_id", F.array(F.col("quality").cast("double")).alias("q"), F.array(F.log1p(F.col("n_chars").cast("double"))).alias("c"))
    ranked = sampling.placed(rounded(scored.select("doc_id", selection.final_score("q", "c").alias("score"))).withColumn("down", -F.col("score")), ["down", "doc_id"], "place")
    return ranked.select("doc_id", (F.col("place") + 1).alias("rank"), "score")


# ---- lexical metrics

SQL_GRAMS = {
    1: r"g AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS g FROM documents)",
    **{n: rf"w AS (SELECT regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), p AS (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE len(w) >= {n}), g AS (SELECT array_to_string(w[i:i+{n - 1}], ' ') AS g FROM p)" for n in (2, 3, 4)},
}


def words(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    return table(spark, d, "documents"), X.words(F.col("text"))


def _entropy(n: int) -> None:
    def f(spark, d):
        return rounded(lexical.entropy(*words(spark, d), n))

    f.__name__ = f"ent{n}"
    query(f"WITH {SQL_GRAMS[n]}, c AS (SELECT count(*) AS c FROM g GROUP BY g) SELECT round(-sum(c / t * log2(c / t)), 6) AS entropy, sum(c)::BIGINT AS total FROM c, (SELECT sum(c) AS t FROM c)")(f)


def _distinct(n: int) -> None:
    def f(spark, d):
        return rounded(lexical.distinct(*words(spark, d), n))

    f.__name__ = f"dist{n}"
    query(f"WITH {SQL_GRAMS[n]} SELECT round(count(DISTINCT g) / count(*), 6) AS distinct_n, count(*)::BIGINT AS total FROM g")(f)


for _n in (1, 2, 3):
    _entropy(_n)
    _distinct(_n)


@query(f"WITH {SQL_GRAMS[1]}, c AS (SELECT count(*) AS c FROM g GROUP BY g) SELECT round(sum(CASE WHEN c <= 100 THEN c ELSE 0 END) / sum(c), 6) AS low_frequency FROM c")
def low_frequency_ratio(spark, d):
    return rounded(lexical.low_frequency(*words(spark, d)))


@query("WITH " + ", ".join(f"x{n} AS (WITH {SQL_GRAMS[n]} SELECT count(DISTINCT g) / count(*) AS r FROM g)" for n in (1, 2, 3, 4)) + " SELECT round((x1.r + x2.r + x3.r + x4.r) / 4, 6) AS ngram_diversity FROM x1, x2, x3, x4")
def ngram_diversity(spark, d):
    return rounded(lexical.ngram_diversity(*words(spark, d)))


WORD_COUNTS = r"""
w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY ALL), n AS (SELECT doc_id, sum(c)::BIGINT AS n FROM c GROUP BY 1)"""


@query(f"""WITH {WORD_COUNTS}, m AS (SELECT doc_id, w, n, product(greatest(n - c - i, 0) / (n - i)) AS miss FROM c JOIN n USING (doc_id), range(30) AS r(i) WHERE n > 30 GROUP BY ALL),
t AS (SELECT doc_id, sum(1 - miss) / 30 AS ttr FROM m GROUP BY 1 UNION ALL SELECT doc_id, count(*) / any_value(n) FROM c JOIN n USING (doc_id) WHERE n <= 30 GROUP BY 1)
SELECT doc_id, round(ttr, 6) AS ttr FROM documents LEFT JOIN t USING (doc_id)""")
def expected_ttr(spark, d):
    return rounded(lexical.expected_ttr(*words(spark, d), "doc_id"))


@query()
def vocd_d(spark, d):
    return rounded(lexical.vocd(*words(spark, d), "doc_id"))


@query()
def vocd_summary(spark, d):
    """Number of documents of 50 tokens and more, with mean, deviation and median of their D."""
    found = lexical.vocd(*words(spark, d), "doc_id")
    return rounded(found.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("deviation"), F.median("d").alias("median")))


@query()
def self_bleu(spark, d):
    """Of the benchmark's passages: a stated, small set."""
    rows = table(spark, d, "benchmark").select("item_id", X.words(F.col("text")).alias("w")).orderBy("item_id").collect()
    return row(spark, self_bleu=round(lexical.self_bleu([r.w for r in rows]), 6))


# ---- geometric and kernel metrics

PAIRS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.v AS va, b.v AS vb FROM e a, e b)"


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS euclidean, round(list_sum([abs(a.v[i] - b.v[i]) FOR i IN range(1, len(a.v) + 1)]), 6) AS manhattan, round(list_max([abs(a.v[i] - b.v[i]) FOR i IN range(1, len(a.v) + 1)]), 6) AS chebyshev FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def vector_distances(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    v, u = F.col("v"), F.col("u")
    return rounded(e.join(b, "vec_id").select("vec_id", V.cosine(v, u).alias("cosine"), V.euclidean(v, u).alias("euclidean"), V.manhattan(v, u).alias("manhattan"), V.chebyshev(v, u).alias("chebyshev")))


@query(f"WITH {PAIRS} SELECT round(sum(1 - list_cosine_similarity(va, vb)), 4) AS distsum, round(sum(1 - list_cosine_similarity(va, vb)) / ((SELECT count(*) * (count(*) - 1) FROM e)), 6) AS distavg FROM p")
def distsum_cosine(spark, d):
    total, mean = geometric.distsum_cosine(table(spark, d, "embeddings"))
    return row(spark, distsum=round(total, 4), distavg=round(mean, 6))


@query(f"WITH {PAIRS} SELECT round(sum(list_distance(va, vb)), 3) AS distsum, round(sum(list_distance(va, vb)) / ((SELECT count(*) * (count(*) - 1) FROM e)), 6) AS distavg FROM p WHERE a <> b")
def distsum_l2(spark, d):
    return geometric.distsum_l2(table(spark, d, "embeddings")).select(F.round("distsum", 3).alias("distsum"), F.round("distavg", 6).alias("distavg"))


@query(f"WITH {PAIRS}, m AS (SELECT a, min(1 - list_cosine_similarity(va, vb)) AS x FROM p WHERE a <> b GROUP BY 1) SELECT round(avg(x), 6) AS knn FROM m")
def knn_distance(spark, d):
    return rounded(geometric.nearest(table(spark, d, "embeddings")).agg(F.avg("distance").alias("knn")))


@query(f"WITH {PAIRS} SELECT a AS vec_id, b AS other, rank FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY 1 - list_cosine_similarity(va, vb), b) AS rank FROM p WHERE a <> b) WHERE rank <= 3")
def nearest_neighbours(spark, d):
    return geometric.nearest(table(spark, d, "embeddings"), k=3).select("vec_id", "other", F.col("rank").cast("long"))


@query("WITH u AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT stddev_samp(x) AS sd FROM u GROUP BY i) SELECT round(exp(avg(ln(greatest(sd, 1e-12)))), 6) AS radius, round(avg(sd), 6) AS mean_sd, round(stddev_pop(sd), 6) AS sd_of_sd FROM s")
def radius(spark, d):
    return rounded(geometric.radius(table(spark, d, "embeddings")))


@query(f"WITH {PAIRS} SELECT round(1 - avg(list_cosine_similarity(va, vb)), 6) AS internal_diversity FROM p")
def internal_diversity(spark, d):
    return row(spark, internal_diversity=round(kernel.internal_diversity(table(spark, d, "embeddings")), 6))


DENSITY = "n AS (SELECT a, list_distance(va, vb) ** 2 AS s, row_number() OVER (PARTITION BY a ORDER BY list_distance(va, vb), b) AS k FROM p WHERE a <> b), r AS (SELECT a, 1 / sqrt(avg(s) + 1e-9::DOUBLE) AS rho FROM n WHERE k <= 5 GROUP BY 1)"


@query(f"WITH {PAIRS}, {DENSITY} SELECT a AS vec_id, round(rho, 5) AS rho FROM r")
def local_density(spark, d):
    return rounded(geometric.density(table(spark, d, "embeddings")), 5)


@query(f"WITH {PAIRS}, {DENSITY}, o AS (SELECT a, CASE WHEN a = b THEN 0 ELSE 1 - list_cosine_similarity(va, vb) END AS x FROM p), k AS (SELECT a, x, row_number() OVER (PARTITION BY a ORDER BY x) AS k FROM o), m AS (SELECT a, sum(x / k) / sum(1.0::DOUBLE / k) AS m FROM k GROUP BY 1) SELECT round(avg(m * rho), 5) AS novelsum FROM m JOIN r USING (a)")
def novelsum(spark, d):
    return rounded(geometric.novelsum(table(spark, d, "embeddings")), 5)


@query()
def vendi_dual(spark, d):
    return row(spark, vendi=round(kernel.vendi_dual(table(spark, d, "embeddings")), 6))


@query()
def logdet_distance(spark, d):
    return row(spark, logdet=round(geometric.logdet(table(spark, d, "embeddings")), 4))


@query()
def logdet_draws(spark, d):
    """Mean and deviation over five draws of 512 rows."""
    found = geometric.logdet_draws(table(spark, d, "embeddings"), ["vec_id"])
    return row(spark, mean=round(float(np.mean(found)), 4), deviation=round(float(np.std(found)), 4))


@query("""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT 0 AS rank, vec_id, v, 'infinity'::DOUBLE AS far, (SELECT min(vec_id) FROM e) AS pick FROM e UNION ALL
  SELECT rank + 1, vec_id, v, far, first_value(vec_id) OVER (ORDER BY gone, far DESC, vec_id) FROM (
    SELECT s.rank, s.vec_id, s.v, CASE WHEN s.vec_id = s.pick THEN -1 ELSE least(s.far, list_distance(s.v, p.v)) END AS far, s.far < 0 OR s.vec_id = s.pick AS gone FROM s JOIN e p ON p.vec_id = s.pick WHERE s.rank < 9))
SELECT DISTINCT rank::INT AS rank, pick AS vec_id FROM s""")
def k_center(spark, d):
    picked = selection.k_center(table(spark, d, "embeddings"), 10)
    return spark.createDataFrame(list(enumerate(picked)), "rank int, vec_id long")


@query("""
WITH RECURSIVE u AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, greatest(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0) AS c FROM embeddings a, embeddings b),
n AS (SELECT count(*) AS n FROM embeddings),
s AS (SELECT 0 AS step, vec_id, 0.0::DOUBLE AS best, [-1]::BIGINT[] AS picked FROM embeddings UNION ALL
  SELECT step + 1, s.vec_id, greatest(s.best, u.c), list_append(s.picked, p.pick) FROM s, u,
    (SELECT b AS pick FROM (SELECT u.b, round(sum(greatest(u.c - s.best, 0)), 9) AS gain FROM s JOIN u ON u.a = s.vec_id WHERE NOT list_contains(s.picked, u.b) GROUP BY u.b) ORDER BY gain DESC, b LIMIT 1) p
  WHERE u.a = s.vec_id AND u.b = p.pick AND s.step < greatest(1, (SELECT n // 10 FROM n))),
f AS (SELECT vec_id, picked FROM s WHERE step = (SELECT max(step) FROM s)),
g AS (SELECT a.vec_id, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS best FROM embeddings a, embeddings b WHERE list_contains((SELECT picked FROM f LIMIT 1), b.vec_id) GROUP BY 1)
SELECT round(sum(best), 6) AS coverage, round(avg(best), 6) AS mean_coverage FROM g""")
def facility_location(spark, d):
    """Lazy greedy over all rows, a tenth of them; scored against all rows."""
    e = table(spark, d, "embeddings")
    keep = selection.facility_rows(e, max(1, e.count() // 10))
    chosen = e.join(F.broadcast(spark.createDataFrame([(k,) for k in keep], "vec_id long")), "vec_id", "left_semi")
    return rounded(geometric.coverage(e, chosen))


@query("""
WITH RECURSIVE o AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY -vec_id % 97, vec_id) AS i FROM embeddings),
x AS MATERIALIZED (SELECT b.i, list(a.vec_id) AS close FROM o a JOIN o b ON a.i < b.i AND list_cosine_similarity(a.v, b.v) > 0.3 GROUP BY b.i),
y AS MATERIALIZED (SELECT o.i, o.vec_id, coalesce(x.close, []) AS close FROM o LEFT JOIN x USING (i)),
s AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
  SELECT y.i, CASE WHEN list_has_any(s.kept, y.close) OR len(s.kept) = 100 THEN s.kept ELSE list_append(s.kept, y.vec_id) END FROM s JOIN y ON y.i = s.i + 1)
SELECT unnest(range(len(kept)))::BIGINT AS rank, unnest(kept) AS vec_id FROM s WHERE i = (SELECT max(i) FROM s)""")
def redundancy_filter(spark, d):
    e = table(spark, d, "embeddings").withColumn("neg", -F.col("vec_id") % 97)
    return selection.redundancy_filter(e, "vec_id", "embedding", ["neg"], 0.3, 100)


@query("""
WITH RECURSIVE o AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY -vec_id % 97, vec_id) AS i FROM embeddings),
n AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE 1 + (i - 2) // 32 END AS batch FROM o),
x AS MATERIALIZED (SELECT b.i, list(a.vec_id) AS close, bool_or(a.batch = b.batch) AS within FROM n a JOIN n b ON a.i < b.i AND list_cosine_similarity(a.v, b.v) > 0.3 GROUP BY b.i),
y AS MATERIALIZED (SELECT o.i, o.vec_id, coalesce(x.close, []) AS close, coalesce(x.within, false) AS within FROM o LEFT JOIN x USING (i)),
s AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
  SELECT y.i, CASE WHEN y.within OR list_has_any(s.kept, y.close) THEN s.kept ELSE list_append(s.kept, y.vec_id) END FROM s JOIN y ON y.i = s.i + 1)
SELECT unnest(range(len(kept)))::BIGINT AS rank, unnest(kept) AS vec_id FROM s WHERE i = (SELECT max(i) FROM s)""")
def redundancy_batches(spark, d):
    """The filter by batches of 32 rows."""
    e = table(spark, d, "embeddings").withColumn("neg", -F.col("vec_id") % 97)
    return selection.redundancy_filter(e, "vec_id", "embedding", ["neg"], 0.3, batch=32)


@query("""
WITH h AS (SELECT label, count(*) FILTER (WHERE vec_id % 2 = 0) AS a, count(*) FILTER (WHERE vec_id % 2 = 1) AS b FROM embeddings GROUP BY 1),
s AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM h),
w AS (SELECT 1e-6 + i * (1 - 2e-6) / 24.0::DOUBLE AS w FROM range(25) AS r(i)),
k AS (SELECT w, sum(CASE WHEN q > 0 THEN q * ln(q / (w * p + (1 - w) * q)) ELSE 0 END) AS kq, sum(CASE WHEN p > 0 THEN p * ln(p / (w * p + (1 - w) * q)) ELSE 0 END) AS kp FROM s, w GROUP BY w),
c AS (SELECT exp(-5 * kq) AS x, exp(-5 * kp) AS y FROM k UNION ALL VALUES (1.0::DOUBLE, 0.0::DOUBLE), (0.0::DOUBLE, 1.0::DOUBLE)),
a AS (SELECT sum((x - px) * (y + py) / 2) AS area FROM (SELECT x, y, lag(x) OVER (ORDER BY x, y DESC) AS px, lag(y) OVER (ORDER BY x, y DESC) AS py FROM c)),
b AS (SELECT sum((y - py) * (x + px) / 2) AS area FROM (SELECT x, y, lag(x) OVER (ORDER BY y, x DESC) AS px, lag(y) OVER (ORDER BY y, x DESC) AS py FROM c))
SELECT round(0.5 * (a.area + b.area), 6) AS mauve FROM a, b""")
def mauve_divergence(spark, d):
    """Of the class histograms of vectors with even and odd ids."""
    e = table(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 2).alias("half")).agg(F.count("*").alias("n")).collect()
    labels = sorted({r.label for r in e})
    p, q = (np.array([sum(r.n for r in e if r.label == c and r.half == h) for c in labels], float) for h in (0, 1))
    return row(spark, mauve=round(kernel.mauve(p / p.sum(), q / q.sum()), 6))


@query("WITH h AS (SELECT label, count(*) FILTER (WHERE vec_id % 2 = 0) AS a, count(*) FILTER (WHERE vec_id % 2 = 1) AS b FROM embeddings GROUP BY 1), s AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM h) SELECT round(sum(CASE WHEN p > 0 THEN p * ln(p / q) ELSE 0 END), 6) AS kl FROM s")
def kl_divergence(spark, d):
    even = F.col("vec_id") % 2 == 0
    h = table(spark, d, "embeddings").groupBy("label").agg(F.count_if(even).alias("a"), F.count_if(~even).alias("b"))
    t = h.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    s = h.join(F.broadcast(t)).select((F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))
    return rounded(s.agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") / F.col("q"))).otherwise(0.0)).alias("kl")))


@query()
def kmeans_inertia(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select(array_to_vector("embedding").alias("features"))
    best = min(KMeans(k=10, seed=s, maxIter=20).fit(e).summary.trainingCost for s in (42, 43, 44))
    return row(spark, inertia=round(best, 4))


@query(f"WITH {PAIRS} SELECT round((SELECT count(*) FROM e) ** 2 / sum(list_cosine_similarity(va, vb) ** 2), 5) AS vendi FROM p")
def vendi_order_two(spark, d):
    return row(spark, vendi=round(kernel.vendi_dual(table(spark, d, "embeddings"), q=2.0), 5))


@query("SELECT label, count(*)::BIGINT AS n, sum(count(*)) OVER (ORDER BY label)::BIGINT AS running FROM embeddings GROUP BY 1")
def running_class_counts(spark, d):
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("running", F.sum("n").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)))
