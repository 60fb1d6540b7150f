"""More queries of the catalogue: templates, turns, filters, contamination, exclusion, splits, classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import scores, templates
from ..functions import text as X
from ..functions import vectors as V
from ..operators import classes, dedup, geometric, kernel, lexical, sampling, selection
from ..sources import adapters, extract
from ..sources.tables import shared_dir, summary, table
from ..streaming import ingest
from . import pool
from .catalogue import REASONS, convs, query, rounded, row

ORDERED = "o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, coalesce(text, '') AS c FROM conversations)"
WORDS = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"


# ---- conversations


def _prompts(name: str, head: str, turn: str) -> None:
    def f(spark, d):
        return convs(spark, d).select("conv_id", F.md5(templates.render(F.col("messages"), name)).alias("prompt_md5"))

    f.__name__ = "prompt_" + name.replace("-", "_").replace(".", "_")
    query(f"WITH {ORDERED} SELECT conv_id, md5({head} || string_agg({turn}, '' ORDER BY i)) AS prompt_md5 FROM o GROUP BY 1")(f)


def _role(a: str, b: str) -> str:
    return f"CASE WHEN i % 2 = 0 THEN '{a}' ELSE '{b}' END"


_prompts("vicuna_v1.1", "'" + templates.CURIOUS.replace("'", "''") + " '", _role("USER", "ASSISTANT") + " || CASE WHEN c = '' THEN ':' ELSE ': ' || c || " + _role(" ", "</s>") + " END")
_prompts("chatglm2", "''", "CASE WHEN i % 2 = 0 THEN '[Round ' || (i // 2 + 1) || ']' || chr(10) || chr(10) ELSE '' END || " + _role("问", "答") + " || '：' || CASE WHEN c = '' THEN '' ELSE c || chr(10) || chr(10) END")
_prompts("dolly_v2", f"'{templates.INSTRUCTION}' || chr(10) || chr(10)", _role("### Instruction", "### Response") + " || ':' || chr(10) || CASE WHEN c = '' THEN '' WHEN i % 2 = 0 THEN c || chr(10) || chr(10) ELSE c || '### End' || chr(10) || chr(10) END")
_prompts("starchat", "'<system>' || chr(10) || '<|end|>' || chr(10)", _role("<|user|>", "<|assistant|>") + " || chr(10) || CASE WHEN c = '' THEN '' ELSE c || '<|end|>' || chr(10) END")
_prompts("llama-2", "CASE WHEN min_by(c, i) = '' THEN '' ELSE '" + templates.RESPECTFUL.replace("'", "''").replace("\n", "' || chr(10) || '") + "' END", "CASE WHEN c = '' THEN " + _role("[INST]", "[/INST]") + " WHEN i = 0 THEN c ELSE " + _role("[INST]", "[/INST]") + " || ' ' || c || " + _role(" ", " </s><s>") + " END")
_prompts("falcon", "''", _role("User", "Assistant") + " || CASE WHEN c = '' THEN ':' ELSE ': ' || replace(replace(c, chr(13) || chr(10), chr(10)), chr(10) || chr(10), chr(10)) || chr(10) || chr(10) END")
_prompts("Robin", "'" + templates.HUMAN.replace("'", "''") + "' || chr(10)", _role("###Human", "###Assistant") + " || ':' || chr(10) || CASE WHEN c = '' THEN '' ELSE c || chr(10) END")
_prompts("oasst_llama", "''", _role("<|prompter|>", "<|assistant|>") + " || CASE WHEN c = '' THEN '' ELSE c || '</s>' END")


@query(f"WITH {ORDERED} SELECT conv_id, coalesce(sum(length(c)) FILTER (WHERE i % 2 = 0), 0)::INT AS instruction, coalesce(sum(length(c)) FILTER (WHERE i % 2 = 1), 0)::INT AS response, sum(length(c))::INT AS total FROM o GROUP BY 1")
def parity_lengths(spark, d):
    m = F.col("messages")
    return convs(spark, d).select("conv_id", M.length_by_parity(m, "instruction").alias("instruction"), M.length_by_parity(m, "response").alias("response"), M.length_by_parity(m).alias("total"))


@query(f"WITH {ORDERED} SELECT conv_id, md5(coalesce(string_agg(c, chr(10) ORDER BY i) FILTER (WHERE i % 2 = 1), '')) AS answers_md5 FROM o GROUP BY 1")
def embedder_answers(spark, d):
    return convs(spark, d).select("conv_id", F.md5(M.answers(F.col("messages"))).alias("answers_md5"))


@query(f"WITH {ORDERED} SELECT a.conv_id, md5(string_agg(CASE WHEN i = n THEN 'closed' ELSE c END, '' ORDER BY i) || 'more') AS text_md5 FROM o a JOIN (SELECT conv_id, max(i) AS n FROM o GROUP BY 1) b USING (conv_id) GROUP BY 1")
def edited_conversations(spark, d):
    """The last turn replaced and one more added."""
    return convs(spark, d).select("conv_id", F.md5(M.flat(M.appended(M.with_last(F.col("messages"), F.lit("closed")), "user", F.lit("more")))).alias("text_md5"))


@query(f"WITH {ORDERED}, n AS (SELECT conv_id, max(i) AS n FROM o GROUP BY 1) SELECT conv_id, md5(chr(10) || chr(10) || 'Human: ' || (SELECT c FROM o x WHERE x.conv_id = n.conv_id AND i = 0) || chr(10) || chr(10) || 'Assistant:') AS prompt_md5, md5((SELECT c FROM o x WHERE x.conv_id = n.conv_id AND i = n.n)) AS chosen_md5, md5('') AS rejected_md5 FROM n WHERE (SELECT c FROM o x WHERE x.conv_id = n.conv_id AND i = 0) <> ''")
def preference_rows(spark, d):
    c = convs(spark, d).select("conv_id", "messages", F.coalesce(F.col("messages")[0]["content"], F.lit("")).alias("first"))
    p = M.preference(F.col("first"), F.col("messages"), F.array().cast("array<struct<role:string,content:string>>"))
    return c.filter("first <> ''").select("conv_id", p.alias("p")).select("conv_id", *[F.md5(f"p.{k}").alias(f"{k}_md5") for k in ("prompt", "chosen", "rejected")])


@query(f"WITH {ORDERED} SELECT conv_id, sum(length(c) * (i + 1))::DOUBLE AS final_score FROM o GROUP BY 1")
def injected_scores(spark, d):
    """Scores per turn joined back as arrays; the score of a conversation is the sum over turns of their product."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("quality"), (F.col("turn") + 1).alias("complexity"))
    return M.scored(convs(spark, d), turns, "conv_id", ["quality", "complexity"]).select("conv_id", selection.final_score("quality", "complexity").alias("final_score"))


@query(f"WITH {REASONS} SELECT 'c::' || CASE WHEN conv_id % 7 = 0 THEN 'x_OASST2' ELSE 'conv' END || '::' || conv_id AS sample_id, CASE WHEN conv_id % 7 = 0 THEN 'excluded_source' ELSE reason END AS reason FROM v")
def chat_records(spark, d):
    c = M.conversations(table(spark, d, "conversations")).select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 7 == 0, "x_OASST2").otherwise("conv").alias("source"), "messages")
    return adapters.chat_rows(c, "c").select("sample_id", "reason")


@query("SELECT doc_id, md5(trim(coalesce(source, '')) || CASE WHEN trim(coalesce(lang, '')) = '' THEN '' ELSE chr(10) || chr(10) || trim(lang) END) AS user_md5, CASE WHEN trim(coalesce(source, '')) = '' THEN 'empty_instruction' WHEN trim(coalesce(text, '')) = '' THEN 'empty_output' END AS reason FROM (SELECT min(doc_id) AS doc_id, source, lang, text FROM documents GROUP BY source, lang, text)")
def instruction_records(spark, d):
    docs = table(spark, d, "documents").groupBy("source", "lang", "text").agg(F.min("doc_id").alias("doc_id"))
    rows = adapters.instruction_rows(docs.select(F.col("source").alias("instruction"), F.col("lang").alias("input"), F.col("text").alias("output"), "doc_id"), "i", "documents", keep=["doc_id"])
    return rows.select("doc_id", F.md5(F.col("messages")[0]["content"]).alias("user_md5"), "reason")


# ---- documents


@query(f"WITH {WORDS} SELECT doc_id, md5(array_to_string(w[1:16], ' ')) AS first_md5, md5(array_to_string(w[-16:], ' ')) AS last_md5 FROM w")
def truncated_tokens(spark, d):
    w = X.words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(M.first_tokens(w, 16), " ")).alias("first_md5"), F.md5(F.array_join(M.last_tokens(w, 16), " ")).alias("last_md5"))


@query(f"WITH {WORDS} SELECT doc_id, len(w)::INT AS n FROM w WHERE len(w) >= 50")
def min_token_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).alias("n")).filter("n >= 50")


@query(f"WITH {WORDS} SELECT count(*) FILTER (WHERE len(w) > 5)::BIGINT AS kept, count(*) FILTER (WHERE len(w) <= 5)::BIGINT AS short FROM w")
def short_context_filter(spark, d):
    n = table(spark, d, "documents").select(F.size(X.words(F.col("text"))).alias("n"))
    return n.agg(F.count_if(F.col("n") > 5).alias("kept"), F.count_if(F.col("n") <= 5).alias("short"))


#: Documents, and items of the benchmark: whole ones, ones within another document, ones with an end of their own.
TAINTED = """
i AS (SELECT item_id, text, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Q: ' || text ELSE text || ' end' END AS doc, CASE item_id % 3 WHEN 2 THEN text || ' end' ELSE text END AS prompt FROM benchmark),
r AS (SELECT doc_id AS key, text AS doc, text AS prompt FROM documents UNION ALL SELECT -1 - item_id, doc, prompt FROM i),
gb AS MATERIALIZED (SELECT DISTINCT item_id, substr(text, p, 5) AS g FROM (SELECT item_id, text, unnest(range(1, length(text) - 3)) AS p FROM benchmark WHERE length(text) >= 5)),
nb AS (SELECT item_id, count(*) AS n FROM gb GROUP BY 1),
gr AS MATERIALIZED (SELECT DISTINCT key, substr(prompt, p, 5) AS g FROM (SELECT key, prompt, unnest(range(1, length(prompt) - 3)) AS p FROM r WHERE length(prompt) BETWEEN 5 AND (SELECT 2 * max(length(text)) FROM benchmark))),
nr AS (SELECT key, count(*) AS n FROM gr GROUP BY 1),
s AS (SELECT key, item_id, count(*) / (any_value(nr.n) + any_value(nb.n) - count(*)) AS s FROM gr JOIN gb USING (g) JOIN nr USING (key) JOIN nb USING (item_id) GROUP BY 1, 2),
b AS (SELECT key, arg_min(item_id, {'s': -s, 'i': item_id}) AS item_id, max(s) AS s FROM s WHERE s >= 0.8 GROUP BY 1),
d AS (SELECT key, min(item_id) AS m FROM r JOIN benchmark x ON coalesce(r.doc, '') = coalesce(x.text, '') GROUP BY 1),
p AS (SELECT key, min(item_id) AS m FROM r JOIN benchmark x ON coalesce(r.prompt, '') = coalesce(x.text, '') GROUP BY 1)"""


@query(f"WITH {TAINTED} SELECT key AS doc_id, coalesce(d.m, p.m, b.item_id) AS matched_id, CASE WHEN d.m IS NOT NULL THEN 'exact_doc' WHEN p.m IS NOT NULL THEN 'exact_prompt' ELSE 'prompt_minhash' END AS match_type, CASE WHEN d.m IS NULL AND p.m IS NULL THEN round(b.s, 6) END AS similarity FROM r LEFT JOIN d USING (key) LEFT JOIN p USING (key) LEFT JOIN b USING (key) WHERE coalesce(d.m, p.m, b.item_id) IS NOT NULL")
def contamination_matches(spark, d):
    """Which documents, and which changed items put among them, are or nearly are items of the benchmark."""
    bench = table(spark, d, "benchmark")
    kind = F.col("item_id") % 3
    own = bench.select((-1 - F.col("item_id")).alias("doc_id"), F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("Q: "), "text")).otherwise(F.concat("text", F.lit(" end"))).alias("text"), F.when(kind == 2, F.concat("text", F.lit(" end"))).otherwise(F.col("text")).alias("prompt"))
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("text").alias("prompt")).unionByName(own)
    return dedup.contamination(docs, bench.select("item_id", "text", F.col("text").alias("prompt")), "doc_id", "text", "prompt", "item_id")


@query("WITH p AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0), m AS (SELECT d.doc_id, d.text, CASE WHEN d.doc_id IN (SELECT doc_id FROM p) THEN 'pool_id' WHEN d.text IN (SELECT text FROM p WHERE text IS NOT NULL) THEN 'pool_content' END AS r FROM documents d), f AS (SELECT text, min(doc_id) AS first FROM m WHERE r IS NULL GROUP BY 1) SELECT doc_id, coalesce(r, CASE WHEN doc_id <> first THEN 'internal_duplicate' END) AS reason FROM m LEFT JOIN f ON m.text = f.text")
def validation_exclusion(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sampling.exclusion_reasons(docs, docs.filter("doc_id % 3 = 0"), "doc_id", "text").select("doc_id", "reason")


@query("SELECT doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT < floor(0.02 * 4294967296) AS held_out FROM documents")
def train_eval_split(spark, d):
    return sampling.hash_split(table(spark, d, "documents"), "doc_id", 0.02).select("doc_id", "held_out")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS p FROM documents), c AS (SELECT lang, row_number() OVER (ORDER BY lang) AS j FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)), g AS (SELECT unnest(range(1, (SELECT count(*) FROM c) + 1)) AS i) SELECT i::INT AS group_id, doc_id, lang FROM g, c JOIN r USING (lang) WHERE j <= i AND p <= 12 // i + CASE WHEN j <= 12 % i THEN 1 ELSE 0 END")
def mode_dropping_groups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    langs = sorted(r.lang for r in docs.filter("lang IS NOT NULL").select("lang").distinct().collect())
    return sampling.first_categories(docs, 12, "lang", langs, "doc_id")


@query(f"""WITH {REASONS}
SELECT 'rows' AS "check", 1::BIGINT AS failures UNION ALL SELECT 'duplicate_ids', 1 UNION ALL SELECT 'invalid_messages', count(*) FROM v WHERE reason IS NOT NULL
UNION ALL SELECT 'misaligned', count(*) FILTER (WHERE conv_id % 5 = 0) + 1 FROM v UNION ALL SELECT 'places', 1""")
def audit_of_faults(spark, d):
    """An audit of all conversations, invalid ones among them, one of them twice, a place left out, and every fifth document at a wrong row: each check counts its faults."""
    rows = convs(spark, d).select(F.col("conv_id").alias("sample_id"), "messages")
    placed = sampling.placed(rows, ["sample_id"], "candidate_index")
    last = placed.agg(F.max("candidate_index").alias("m"), F.max("sample_id").alias("s")).first()
    docs = placed.select("sample_id", F.when(F.col("sample_id") % 5 == 0, F.col("candidate_index") + 100_000).otherwise(F.col("candidate_index")).alias("row_index"))
    valid = rows.filter(M.invalid_reason(F.col("messages")).isNull()).agg(F.min("sample_id")).first()[0]
    again = placed.filter(F.col("sample_id") == valid).withColumn("candidate_index", F.lit(last.m + 2))
    return pool.audit(placed.unionByName(again), docs, last.m + 1)


@query(f"""WITH {REASONS} SELECT * FROM (VALUES ('duplicate_ids', 0::BIGINT), ('invalid_messages', 0), ('misaligned', 0), ('places', 0)) c("check", failures) WHERE (SELECT count(*) FROM v WHERE reason IS NULL) > 0""")
def candidate_pool_audit(spark, d):
    """A pool of half the valid rows, audited against its tables; that faults are found is seen in ``audit_of_faults``."""
    c = M.conversations(table(spark, d, "conversations")).select(F.col("conv_id").alias("id"), F.lit("conv").alias("source"), "messages")
    return pool_audited(spark, adapters.chat_rows(c, "c"), table(spark, d, "benchmark"))


def pool_audited(spark, records, benchmark):
    """A pool of half the valid rows, without what is near to the benchmark or to another row, against its exported tables."""
    dev = benchmark.select("item_id", F.col("text").alias("doc"), F.col("text").alias("prompt"))
    target = max(1, records.filter("reason IS NULL").count() // 2)
    made = pool.build(records, dev, target, base=2, dev_id="item_id")["pool"]
    path = shared_dir(spark)
    pool.export(spark, made, path)
    read = lambda name, more: spark.read.schema(f"row_index long, sample_id string, {more}").json(f"{path}/{name}")
    messages = read("canonical", "messages array<struct<role:string,content:string>>").withColumnRenamed("row_index", "candidate_index")
    docs = read("docs", "doc string").join(made.select("sample_id", "doc"), ["sample_id", "doc"], "left_semi")
    return pool.audit(made.select("sample_id", "candidate_index").join(messages, ["sample_id", "candidate_index"], "left"), docs)


@query("SELECT 'text' AS \"column\", count(*)::BIGINT AS n, count(*) FILTER (WHERE text IS NULL)::BIGINT AS nulls, min(text) AS least, max(text) AS greatest FROM documents UNION ALL SELECT 'doc_id', count(*), count(*) FILTER (WHERE doc_id IS NULL), min(doc_id)::VARCHAR, max(doc_id)::VARCHAR FROM documents UNION ALL SELECT 'lang', count(*), count(*) FILTER (WHERE lang IS NULL), min(lang), max(lang) FROM documents UNION ALL SELECT 'source', count(*), count(*) FILTER (WHERE source IS NULL), min(source), max(source) FROM documents UNION ALL SELECT 'n_chars', count(*), count(*) FILTER (WHERE n_chars IS NULL), min(n_chars)::VARCHAR, max(n_chars)::VARCHAR FROM documents")
def column_summary(spark, d):
    return summary(table(spark, d, "documents"))


# ---- diversity by role


GROUPED = r"t AS (SELECT role, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM conversations), p AS (SELECT role, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM t, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n), c AS (SELECT role, n, array_to_string(w[i:i + n - 1], ' ') AS g, count(*) AS c FROM p GROUP BY 1, 2, 3)"


@query(f"WITH {GROUPED}, s AS (SELECT *, sum(c) OVER (PARTITION BY role, n) AS t FROM c) SELECT role, s.n::INT AS n, round(count(*) / sum(c), 6) AS distinct_n, round(-sum(c / t * log2(c / t)), 6) AS entropy, sum(c)::BIGINT AS total, CASE WHEN s.n = 1 THEN round(sum(CASE WHEN c <= 100 THEN c ELSE 0 END) / sum(c), 6) END AS low_frequency FROM s GROUP BY role, s.n")
def role_diversity(spark, d):
    return rounded(lexical.report(table(spark, d, "conversations"), X.words(F.col("text")), "role"))


# ---- vectors, classes and scores


@query("WITH x AS (SELECT vec_id, embedding[1:6]::DOUBLE[] AS l FROM embeddings), e AS (SELECT vec_id, [exp(v - list_max(l)) FOR v IN l] AS w FROM x) SELECT vec_id, round(list_sum([w[i] * i FOR i IN range(1, 7)]) / list_sum(w), 6) AS quality FROM e")
def expected_quality(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", scores.expected_quality(F.slice("embedding", 1, 6)).alias("quality")))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(list_sum([x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v]), 6) AS unit_sum, true AS finite FROM e")
def unit_vectors(spark, d):
    u = V.normalized(F.col("embedding"))
    return rounded(table(spark, d, "embeddings").select("vec_id", F.aggregate(u, F.lit(0.0), lambda a, x: a + x).alias("unit_sum"), V.finite(F.col("embedding")).alias("finite")))


@query("WITH h AS (SELECT label, count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY 1) SELECT label, round(CASE WHEN p > 0.1 THEN -1 ELSE 1 - p END, 6) AS weight FROM h")
def class_weights(spark, d):
    p = F.col("p")
    return rounded(kernel.histogram(table(spark, d, "embeddings"), "label").select("label", F.when(p > 0.1, F.lit(-1.0)).otherwise(1 - p).alias("weight")))


def _balanced(seed: int, g: int) -> str:
    """SQL of one group: 3 rows of each class by hash order, then 10 others."""
    h = f"md5('{seed + g}:' || vec_id)"
    return f"SELECT {g} AS group_id, vec_id, label FROM (SELECT *, sum(CASE WHEN p > 3 THEN 1 ELSE 0 END) OVER (ORDER BY {h}, vec_id) AS f FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {h}, vec_id) AS p FROM embeddings)) WHERE p <= 3 OR f <= 40 - (SELECT sum(least(3, n)) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))"


@query(f"{_balanced(46, 0)} UNION ALL {_balanced(46, 1)}")
def cluster_balanced_groups(spark, d):
    e = table(spark, d, "embeddings")
    return sampling.balanced_sample(e, "label", "vec_id", 2, 40, 46, per_class=3).select("group_id", "vec_id", "label")


@query()
def semantic_classes(spark, d):
    return classes.pca_kmeans(10)(table(spark, d, "embeddings")).select("vec_id", "sem_id")


@query()
def component_count(spark, d):
    """Principal axes until 90 % of the variance, and the share that they reach."""
    _, axes, part = classes.components(table(spark, d, "embeddings"))
    return row(spark, components=len(axes), reached=round(float(np.cumsum(part)[len(axes) - 1]), 6))


@query()
def vendi_orders(spark, d):
    e = table(spark, d, "embeddings")
    return spark.createDataFrame([(str(q), round(kernel.vendi_dual(e, q=q), 6)) for q in (0.5, 1.0, 2.0, np.inf)], "q string, vendi double")


@query()
def ngram_vendi(spark, d):
    """Of the benchmark's items, which are few: its kernel is gathered."""
    rows = [(r.text or "").split() for r in table(spark, d, "benchmark").orderBy("item_id").collect()]
    return row(spark, ngram_vendi=round(kernel.ngram_vendi(rows), 6))


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS c, list_distance(a.v, b.v) ** 2 AS s FROM e a, e b),
r AS MATERIALIZED (SELECT a, 1 / sqrt(avg(s) + 1e-9::DOUBLE) AS rho FROM (SELECT a, s, row_number() OVER (PARTITION BY a ORDER BY s, b) AS k FROM p WHERE a <> b) WHERE k <= 10 GROUP BY 1),
f AS MATERIALIZED (SELECT p.a, p.b, (1 - p.c) * (x.rho + y.rho) AS d FROM p JOIN r x ON x.a = p.a JOIN r y ON y.a = p.b),
s AS (SELECT 1 AS n, [min(vec_id)] AS picked FROM e UNION ALL
  SELECT n + 1, list_append(picked, pick) FROM s, (
    SELECT a AS pick FROM (SELECT a, round(avg(d / k), 12) AS gain FROM (SELECT f.a, f.d, row_number() OVER (PARTITION BY f.a ORDER BY f.d) AS k FROM f, s WHERE list_contains(s.picked, f.b) AND NOT list_contains(s.picked, f.a)) GROUP BY a) ORDER BY gain DESC, a LIMIT 1)
  WHERE n < 4)
SELECT unnest(range(4))::INT AS rank, unnest(picked) AS doc_id FROM s WHERE n = 4""")
def novelty_selection(spark, d):
    """Four of all rows by greedy novelty, with densities of ten neighbours."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rho = geometric.density(e, "doc_id", k=10)
    picked = selection.novelty_rows(e, 4, rho, "doc_id")
    return spark.createDataFrame(list(enumerate(picked)), "rank int, doc_id long")


@query("SELECT item_id, round(-length(text) / 100.0::DOUBLE, 6) AS ln_probability FROM benchmark")
def extracted_features(spark, d):
    """The client of an outside model with a stand-in that answers out of order: minus a hundredth of a text's length."""

    def transport():
        return lambda texts: [{"index": i, "y": -len(t) / 100} for i, t in reversed(list(enumerate(texts)))]

    def send():
        ask = transport()
        return lambda texts: [{"index": r["index"], "ln_probability": r["y"]} for r in ask(texts)]

    return rounded(extract.extract(table(spark, d, "benchmark"), "item_id", "text", send, "ln_probability", "double"))


# ---- streams


@query("SELECT sha256(coalesce(text, '')) AS text_hash, count(*)::BIGINT * 0 + 1 AS n FROM documents GROUP BY 1")
def streaming_ingest(spark, d):
    """Documents read as a stream, without repeats of a text, into a table that is read back."""
    out, state = shared_dir(spark), shared_dir(spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    # a pattern names the table whether it is one file or a folder of them: a stream reads no path of one file
    ingest.ingest(spark, f"{d}/[d]ocuments.parquet", schema, "text", out, state).awaitTermination()
    return spark.read.parquet(out).groupBy("text_hash").agg(F.count("*").alias("n"))
