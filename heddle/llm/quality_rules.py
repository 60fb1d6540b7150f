"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Measures are taken from one array of words and one of lines; the 5-word windows that repeat are found by
hashes of windows, and only texts that have some pay for sorting them. ``RULES`` can be replaced by
any other table of the same form.

Null texts count as empty: no words, and so ``base_failed``. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = "the of and to in is that it for on as with was by are be this at from or an et de la le les des du un une est que qui dans pour pas sur au par der die das und ist nicht ein eine zu den mit von sich auf im dem als el los las en y se del con una su para al es lo no".split()


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * part / whole <= high``, for texts of at least ``words`` words; measures by name."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None
    words: int = 0

    def sql(self) -> str:
        tests = [f"100 * {self.part} {op} {limit:g} * {self.whole}" for op, limit in ((">=", self.low), ("<=", self.high)) if limit is not None]
        return f"({' AND '.join(tests)}" + f" OR n_words < {self.words}" * (self.words > 0) + ")"


RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 2000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 60),
    Rule("stop_words", "n_stop", "n_words", 5, None, words=30),
)

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+', 0)"
#: Covered places of the windows of 5 hashes h that occur twice or more.
REPEATED = """
  CASE WHEN size(h) < 5 THEN 0L ELSE
    transform(array(transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]))), v ->
      CASE WHEN size(array_distinct(v)) = size(v) THEN 0L ELSE
        transform(array(sort_array(transform(v, (x, i) -> struct(x AS x, i AS i)))), s ->
          transform(array(sort_array(transform(filter(s, (e, k) -> e.x = get(s, k - 1).x OR e.x = get(s, k + 1).x), e -> e.i))), p ->
            aggregate(transform(p, (x, k) -> CASE WHEN k = 0 THEN 5 ELSE least(5, x - p[k - 1]) END), 0L, (a, b) -> a + b))[0])[0]
      END)[0]
  END"""


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def measures(text: str = "text") -> str:
    """A struct of all measures of a text column, as one SQL expression."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    lines = rf"filter(split(coalesce({text}, ''), '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    body = f"""struct(
      cast(size(w) AS long) AS n_words,
      cast(aggregate(w, 0, (a, x) -> a + length(x)) AS long) AS word_chars,
      cast(regexp_count(coalesce({text}, ''), '[#*$%&|<>]') AS long) AS n_symbols,
      cast(size(l) AS long) AS n_lines,
      cast(size(l) - size(array_distinct(l)) AS long) AS n_dup_lines,
      {_let("transform(w, x -> xxhash64(x))", "h", REPEATED)} AS n_repeat_words,
      cast(size(filter(w, x -> x IN ({stop}))) AS long) AS n_stop)"""
    return _let(WORDS.format(text=text), "w", _let(lines, "l", body))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base measures, base_failed, a boolean per rule (``ok_<name>``) and kept."""
    m = docs.select(F.col(doc_id).alias("doc_id"), F.expr(measures(text)).alias("m")).select("doc_id", "m.*")
    checked = m.withColumns({"base_failed": F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")} | {f"ok_{r.name}": F.expr(r.sql()) for r in rules})
    return checked.withColumn("kept", F.expr(" AND ".join(["NOT base_failed", *(f"ok_{r.name}" for r in rules)])))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
v AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
x AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM v),
r AS (SELECT doc_id, g FROM x GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM x JOIN r USING (doc_id, g), range(5) AS o(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len([y FOR y IN w IF y IN ({stop})])::BIGINT AS n_stop
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(r.sql() for r in rules)} AS kept FROM b"""
