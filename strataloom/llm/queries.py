"""Queries of the training-data operators, and their SQL where it is plain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.instants import epoch_us
from strataloom.llm import groups, leaks, repetition, runs, terms
from strataloom.llm.mixture import Mixture
from strataloom.session import table


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = runs.event_classes(table(spark, sf_dir, "patterns"), "id", "file_group_id", "template")
    return runs.repeated_runs(
        table(spark, sf_dir, "occurrences"),
        "log_source_id",
        "byte_offset",
        "pattern_id",
        "id",
        epoch_us(F.col("entry_timestamp")),
        classes,
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_runs(spark, sf_dir).select("log_source_id", "first_byte_offset", "last_byte_offset")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.linked_by_identifiers(table(spark, sf_dir, "occurrences"), "id", "pattern_id", "variables")


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = terms.term_scores(table(spark, sf_dir, "patterns"), "id", "file_group_id", "template")
    return scores.withColumnRenamed("key", "pattern_id").withColumnRenamed("group", "file_group_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = terms.term_scores(
        table(spark, sf_dir, "patterns"), "id", "file_group_id", "template", k1=float("inf"), b=0.0, idf="plain"
    )
    return terms.most_characteristic(scores.where("n_with_term > 1")).select(F.col("key").alias("pattern_id"), "term")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(
        table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text"
    )


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).pieces()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).shares()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = repetition.repetition(table(spark, sf_dir, "documents"), "doc_id", "text")
    return scored.withColumn("votes", F.array_join(F.transform("votes", lambda v: v.cast("string")), ","))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = repetition.repetition(table(spark, sf_dir, "documents"), "doc_id", "text")
    return repetition.repetitive(scored).select("doc_id")


_TERMS = """w AS (SELECT id, file_group_id g, regexp_extract_all(lower(template), '[\\p{L}\\p{N}]+') k FROM patterns),
 z AS (SELECT g, count(*) n_records, avg(coalesce(len(k), 0)) m FROM w GROUP BY g),
 u AS (SELECT id, g, len(k) l, unnest(k) term FROM w),
 c AS (SELECT id, g, term, l, count(*) uses FROM u GROUP BY ALL),
 d AS (SELECT g, term, count(*) n_with_term FROM c GROUP BY ALL),
 j AS (SELECT c.*, n_records, n_with_term, m FROM c JOIN d ON d.term = c.term AND d.g IS NOT DISTINCT FROM c.g
  JOIN z ON z.g IS NOT DISTINCT FROM c.g)"""

_RUNS = """WITH o AS (SELECT log_source_id s, byte_offset b, arg_min(pattern_id, id) p, arg_min({ 't': entry_timestamp }, id).t x FROM occurrences
  WHERE log_source_id IS NOT NULL AND byte_offset IS NOT NULL AND pattern_id IS NOT NULL GROUP BY ALL),
 t AS (SELECT id, file_group_id g, list_filter(regexp_split_to_array(template, '\\s+'), lambda x: x <> '') k FROM patterns),
 e AS (SELECT s, b, p, CASE WHEN x >= 946684800 AND x < 4102444800 THEN x * 1000000 WHEN x >= 946684800000 AND x < 4102444800000 THEN x * 1000
  WHEN x >= 946684800000000 AND x < 4102444800000000 THEN x WHEN x >= 946684800000000000 AND x < 4102444800000000000 THEN x // 1000 END AS e FROM o),
 n AS (SELECT s, b, p, e, lag(p) OVER (PARTITION BY s ORDER BY b) q FROM e),
 d AS (SELECT DISTINCT p, q FROM n WHERE p <> q),
 a AS (SELECT d.p, d.q FROM d JOIN t x ON x.id = d.p JOIN t y ON y.id = d.q WHERE x.g = y.g AND len(x.k) = len(y.k)
  AND len(list_filter(range(1, len(x.k) + 1), lambda i: x.k[i] <> y.k[i] AND x.k[i] <> '<*>' AND y.k[i] <> '<*>')) = 0),
 m AS (SELECT n.*, CASE WHEN n.p = n.q OR a.p IS NOT NULL THEN 0 ELSE 1 END f FROM n LEFT JOIN a ON a.p = n.p AND a.q = n.q),
 c AS (SELECT *, sum(f) OVER (PARTITION BY s ORDER BY b) r FROM m)"""

_GRAMS = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') k FROM documents WHERE text IS NOT NULL)"""

SQL = {
    "p8_found": f"""WITH {_GRAMS}, d AS (SELECT doc_id, array_to_string(k[i:i + 11], ' ') g FROM (SELECT doc_id, k, unnest(range(1, len(k) - 10)) i FROM w)),
 x AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') k FROM eval_items),
 e AS (SELECT item_id, array_to_string(k[i:i + 11], ' ') g FROM (SELECT item_id, k, unnest(range(1, len(k) - 10)) i FROM x))
 SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)""",
    "p10_found": f"""WITH {_GRAMS}, g AS (SELECT doc_id, len(k) n, i, row_number() OVER (PARTITION BY doc_id, array_to_string(k[i:i + 7], ' ') ORDER BY i) r
   FROM (SELECT doc_id, k, unnest(range(1, len(k) - 6)) i FROM w WHERE len(k) >= 16)),
 c AS (SELECT doc_id, n, unnest(range(i, i + 8)) p FROM g WHERE r > 1)
 SELECT doc_id FROM c GROUP BY doc_id HAVING count(DISTINCT p) >= 0.25 * min(n)""",
    "p6_scores": f"""WITH {_TERMS} SELECT id AS pattern_id, g AS file_group_id, term, uses, n_records, n_with_term,
 round(uses * 2.2 / (uses + 1.2 * (0.25 + 0.75 * l / m)) * ln(1 + (n_records - n_with_term + 0.5) / (n_with_term + 0.5)), 6) AS score
 FROM j""",
    "p6_found": f"""WITH {_TERMS}, s AS (SELECT id, term, round(uses * ln(n_records / n_with_term), 6) score FROM j
  WHERE n_with_term > 1), b AS (SELECT *, max(score) OVER (PARTITION BY id) best FROM s)
 SELECT id AS pattern_id, term FROM b WHERE score = best AND score > 0""",
    "p4_found": """WITH RECURSIVE v AS (SELECT id, pattern_id p, regexp_extract(unnest(string_split(variables, chr(9))),
   '^[^\\p{L}\\p{N}]*(?:[a-z]+[=:])?((?s:.*))$', 1) x FROM occurrences),
 y AS (SELECT id, p, x, regexp_extract_all(x, '[\\p{L}\\p{N}]+') w FROM v WHERE length(x) >= 16),
 z AS (SELECT id, p, lower(array_to_string(w, '')) t FROM y
   WHERE NOT (x LIKE '%.%.%.%' AND len(list_filter(w[1:4], lambda q: try_cast(q AS UTINYINT) IS NOT NULL)) = 4)),
 k AS (SELECT DISTINCT id, p, CASE WHEN t LIKE '0x%' THEN substr(t, 3) ELSE t END h FROM z
   WHERE length(CASE WHEN t LIKE '0x%' THEN substr(t, 3) ELSE t END) = 16 AND trim(CASE WHEN t LIKE '0x%' THEN substr(t, 3) ELSE t END, '0123456789abcdef') = ''),
 i AS (SELECT h, min(id) f FROM k WHERE h <> repeat(substr(h, 1, 1), 16) GROUP BY h HAVING count(DISTINCT p) > 1),
 r AS (SELECT k.id, i.f FROM k JOIN i USING (h)),
 e AS (SELECT DISTINCT r.f a, s.f b FROM r JOIN r s USING (id) WHERE r.f <> s.f),
 c(a, l) AS (SELECT DISTINCT f, f FROM r UNION SELECT e.b, c.l FROM c JOIN e ON e.a = c.a WHERE c.l < e.b),
 g AS (SELECT a, min(l) l FROM c GROUP BY a)
 SELECT DISTINCT r.id, min(g.l) OVER (PARTITION BY r.id) AS group_id FROM r JOIN g ON g.a = r.f""",
    "p1_found": f"""{_RUNS} SELECT s AS log_source_id, min(b) AS first_byte_offset, max(b) AS last_byte_offset FROM c GROUP BY s, r
 HAVING count(*) >= 3""",
    "p1_runs": f"""{_RUNS}, z AS (SELECT s, r, min(b) lo, max(b) hi, count(*) n, min(e) t0, max(e) t1 FROM c GROUP BY s, r)
 SELECT s AS log_source_id, lo AS first_byte_offset, hi AS last_byte_offset, n AS n_events, t0 AS first_us, t1 AS last_us, t1 - t0 AS duration_us
 FROM z WHERE n >= 3""",
}

QUERIES = {f.__name__: f for f in (p1_runs, p1_found, p4_found, p6_scores, p6_found, p8_found, p9_mixture, p9_shares, p10_scores, p10_found)}
