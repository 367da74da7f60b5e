"""Queries of the log-pattern catalogue and their SQL.

Every query runs over the whole of its tables. Arrays are rendered as text and doubles rounded, so that results compare
as values; queries without SQL are iterative, or too slow in plain SQL, and are tested against brute force.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import tokens as tk
from strataloom.functions.stamps import extract_timestamp
from strataloom.operators import compare, correlate, dedup, mining, rank, search, structure, tags, tickets
from strataloom.plans.corpora import DOCUMENT_LINES_SQL, EVENT_LINES_SQL, EVOLVING_LINES_SQL, document_lines, event_lines, evolving_lines
from strataloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def joined(col: str, sep: str = " "):
    return F.array_join(F.col(col), sep)


# Lines and tokens ----------------------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(line, '[ \\t\\n\\f\\r]+'), lambda x: x <> '')"
_IS_VAR = """(contains(t, '/') OR contains(t, chr(92)) OR (length(t) - length(replace(t, '-', '')) >= 2 AND strlen(t) > 10)
 OR (length(t) > length(regexp_replace(t, '[0-9]', '', 'g'))
  AND (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) * 100 // strlen(t) >= 30))"""
_MASKED = f"list_transform(k, lambda t: CASE WHEN {_IS_VAR} THEN '<*>' ELSE t END)"
_LINES = f'l AS (SELECT "group", source, byte_offset, line, {_TOKENS} AS k FROM {EVENT_LINES_SQL})'
_MINED = f"""{_LINES}, m AS (SELECT "group", source, byte_offset, line, k, {_MASKED} AS t FROM l),
 p AS (SELECT "group", array_to_string(t, ' ') AS template, count(*) AS occurrence_count FROM m GROUP BY ALL)"""


def _event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.tokenized(event_lines(spark, sf_dir), "group", "source", "byte_offset", "line")


@query(f"WITH {_LINES} SELECT byte_offset, len(k) AS n_tokens, array_to_string(k, '|') AS tokens FROM l")
def tokenize_tokens(spark, sf_dir):
    t = event_lines(spark, sf_dir).select("byte_offset", tk.tokenize(F.col("line")).alias("k"))
    return t.select("byte_offset", F.size("k").alias("n_tokens"), joined("k", "|").alias("tokens"))


# by pieces and running bracket depth, as brackets of any depth are no regular language
_BY_DEPTH = """(list_reduce(list_transform(regexp_extract_all({0}, '[ \\t\\n\\f\\r]|[^ \\t\\n\\f\\r]+'), lambda p: {{'d': []::VARCHAR[], 'n': p, 'k': 0}}),
 lambda a, x: CASE WHEN trim(x.n, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) = '' AND a.k <= 0
   THEN {{'d': CASE WHEN a.n = '' THEN a.d ELSE list_append(a.d, a.n) END, 'n': '', 'k': 0}}
   ELSE {{'d': a.d, 'n': a.n || x.n, 'k': a.k + (2 * length(x.n) - length(replace(x.n, '(', '')) - length(replace(x.n, '[', ''))
     - (2 * length(x.n) - length(replace(x.n, ')', '')) - length(replace(x.n, ']', ''))))::INT}} END,
 {{'d': []::VARCHAR[], 'n': '', 'k': 0}}))"""
_DOC_TOKENS = f"""r AS (SELECT "group", source, byte_offset, line, {_BY_DEPTH.format('line')} AS a FROM {DOCUMENT_LINES_SQL}),
 l AS (SELECT "group", source, byte_offset, line, CASE WHEN a.n = '' THEN a.d ELSE list_append(a.d, a.n) END AS k FROM r)"""


@query(f"WITH {_DOC_TOKENS} SELECT source, byte_offset, len(k) AS n_tokens, array_to_string(k, '|') AS tokens FROM l")
def tokenize_documents(spark, sf_dir):
    t = document_lines(spark, sf_dir).select("source", "byte_offset", tk.tokenize(F.col("line")).alias("k"))
    return t.select("source", "byte_offset", F.size("k").alias("n_tokens"), joined("k", "|").alias("tokens"))


_SHAPE = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr({0}, 1, 20), '[A-Za-z]+', 'a', 'g'),
 '[0-9]+', 'd', 'g'), ':+', ':', 'g'), '-+', '-', 'g'), '[*]+', '*', 'g')"""


@query(f"WITH {_LINES} SELECT byte_offset, array_to_string(list_transform(k, lambda x: {_SHAPE.format('x')}), ' ') AS shapes FROM l")
def token_shape(spark, sf_dir):
    k = tk.tokenize(F.col("line"))
    return event_lines(spark, sf_dir).select("byte_offset", F.array_join(F.transform(k, tk.token_shape), " ").alias("shapes"))


@query(f"WITH {_LINES} SELECT byte_offset, {_SHAPE.format('k[1]')} || '|' || {_SHAPE.format('k[2]')} AS fingerprint, false AS indented FROM l")
def line_fingerprint(spark, sf_dir):
    line = F.col("line")
    return event_lines(spark, sf_dir).select(
        "byte_offset", tk.line_fingerprint(line).alias("fingerprint"), tk.is_indented(line).alias("indented")
    )


@query(f"""WITH {_LINES}, f AS (SELECT source, {_SHAPE.format('k[1]')} || '|' || {_SHAPE.format('k[2]')} AS fingerprint FROM l),
 c AS (SELECT source, fingerprint, count(*) n FROM f GROUP BY ALL),
 r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY n DESC, fingerprint ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b,
  sum(n) OVER (PARTITION BY source) t, row_number() OVER (PARTITION BY source ORDER BY n DESC, fingerprint) i FROM c)
 SELECT source, fingerprint, n FROM r WHERE i = 1 OR b < floor(t * 0.9)""")  # fmt: skip
def entry_fingerprints(spark, sf_dir):
    return structure.entry_fingerprints(event_lines(spark, sf_dir), "source", "line")


def _document_entries(spark, sf_dir) -> DataFrame:
    lines = document_lines(spark, sf_dir).withColumn("source", F.col("source").cast("string"))
    prints = structure.entry_fingerprints(lines, "group", "line").withColumnRenamed("source", "g")
    marked = structure.mark_starts(lines, "group", "line", prints.withColumnRenamed("g", "source"))
    return structure.group_entries(marked, "source", "byte_offset", "next_offset", "line")


_DOC_SHAPES = f"""b AS (SELECT "group", source, byte_offset, line, regexp_matches(line, '^[ \\t]') AS i,
  list_transform(list_filter(regexp_split_to_array(line, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '')[1:2], lambda x: string_split(
   regexp_replace(regexp_replace(substr(x, 1, 20), '[A-Za-z]+', 'a', 'g'), '[0-9]+', 'd', 'g'), '')) AS c FROM {DOCUMENT_LINES_SQL}),
 f AS (SELECT "group", source, byte_offset, line, i, array_to_string(list_transform(c, lambda s: array_to_string(list_transform(
  list_filter(range(1, len(s) + 1), lambda j: j = 1 OR s[j] <> s[j - 1]), lambda j: s[j]), '')), '|') AS fp FROM b),
 n AS (SELECT "group", fp, count(*) n FROM f WHERE NOT i AND fp <> '' GROUP BY ALL),
 r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY "group" ORDER BY n DESC, fp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b,
  sum(n) OVER (PARTITION BY "group") t, row_number() OVER (PARTITION BY "group" ORDER BY n DESC, fp) q FROM n),
 g AS (SELECT "group", fp FROM r WHERE q = 1 OR b < floor(t * 0.9)),
 s AS (SELECT f.*, "group" NOT IN (SELECT "group" FROM g) OR (NOT i AND g.fp IS NOT NULL) AS start FROM f LEFT JOIN g USING ("group", fp)),
 e AS (SELECT *, sum(start::INT) OVER (PARTITION BY source ORDER BY byte_offset) AS e FROM s)"""


@query(f"""WITH {_DOC_SHAPES} SELECT source::VARCHAR AS source, min(byte_offset) AS byte_offset, max(byte_offset) + 1 AS next_offset,
 arg_min(line, byte_offset) AS primary_line, count(*) - 1 AS n_more FROM e WHERE e > 0 GROUP BY source, e""")
def group_entries(spark, sf_dir):
    """Entries of the documents, whose start shapes are learnt per language."""
    e = _document_entries(spark, sf_dir)
    return e.select("source", "byte_offset", "next_offset", "primary_line", F.size("continuation").alias("n_more"))


@query(f"""SELECT source, min(byte_offset) AS byte_offset, max(byte_offset) + 1 AS next_offset, count(*) - 1 AS n_more FROM (
 SELECT source, byte_offset, sum(CASE WHEN regexp_matches(line, '^[^ \\t]') THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY byte_offset) AS e
 FROM {DOCUMENT_LINES_SQL}) WHERE e > 0 GROUP BY source, e""")
def group_indented(spark, sf_dir):
    """Entries of the documents that begin at lines with a first character that is no blank."""
    lines = document_lines(spark, sf_dir).withColumn("is_start", F.col("line").rlike(r"^[^ \t]"))
    e = structure.group_entries(lines, "source", "byte_offset", "next_offset", "line")
    return e.select(F.col("source").cast("bigint").alias("source"), "byte_offset", "next_offset", F.size("continuation").alias("n_more"))


@query(f"""WITH {_LINES}, u AS (SELECT DISTINCT unnest(k) AS t FROM l) SELECT t AS token, {_IS_VAR} AS is_variable FROM u""")
def is_variable_flags(spark, sf_dir):
    t = event_lines(spark, sf_dir).select(F.explode(tk.tokenize(F.col("line"))).alias("token")).distinct()
    return t.select("token", tk.is_variable(F.col("token")).alias("is_variable"))


@query(f"WITH {_LINES} SELECT byte_offset, array_to_string({_MASKED}, ' ') AS masked FROM l")
def mask_tokens(spark, sf_dir):
    return _event_tokens(spark, sf_dir).select("byte_offset", tk.render(F.col("masked")).alias("masked"))


def _stamped(form: Callable, year: int = 2024) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        line = F.concat(form(F.col("ts")), F.lit(" rest of the line"))
        return e.select("event_id", extract_timestamp(line, year).alias("entry_timestamp"))

    return run


_FORMS = {
    "iso_t": lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    "comma": lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss,SSS"),
    "dot": lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS"),
    "syslog": lambda t: F.date_format(t, "MMM dd HH:mm:ss"),
    "clf": lambda t: F.concat(F.date_format(t, "'['dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0200]")),
    "epoch": lambda t: F.unix_seconds(t.cast("timestamp")).cast("string"),
}
for _name, _form in _FORMS.items():
    QUERIES[f"extract_timestamp_{_name}"] = _stamped(_form)
    SQL[f"extract_timestamp_{_name}"] = "SELECT event_id, epoch_us(ts) // 1000000 AS entry_timestamp FROM events"

_DAY8 = "(?:19[0-9][0-9]|20[0-9][0-9]|2100)(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])"


@query(f"""WITH n AS (SELECT id, file_path, regexp_replace(regexp_extract(file_path, '[^/]+$'), '[0-9]{{4}}[-_][0-9]{{2}}[-_][0-9]{{2}}', '', 'g') AS a FROM log_sources),
 d AS (SELECT id, regexp_replace(regexp_replace(a, '{_DAY8}([^0-9]|$)', '\\1', 'g'), '([.][0-9]+)+$', '') AS b FROM n),
 s AS (SELECT id, string_split(regexp_replace(regexp_replace(b, '[._-]+', '.', 'g'), '^[.]|[.]$', '', 'g'), '.') AS g FROM d),
 t AS (SELECT id, list_transform(g, lambda x: CASE WHEN regexp_full_match(x, '[0-9]*') THEN x ELSE regexp_replace(x, '[0-9]+$', '') END) AS g FROM s)
 SELECT id, array_to_string(list_transform(list_filter(range(1, len(g) + 1), lambda i: i = 1 OR g[i] <> g[i - 1]), lambda i: g[i]), '.') AS group_name FROM t""")
def group_name(spark, sf_dir):
    return table(spark, sf_dir, "log_sources").select("id", tk.group_name(F.col("file_path")).alias("group_name"))


@query("""SELECT g.name AS "group", count(*) AS n_files, string_agg(file_path, ' ' ORDER BY file_path) AS files
 FROM log_sources s JOIN file_groups g ON g.id = s.file_group_id GROUP BY g.name""")
def group_files(spark, sf_dir):
    g = table(spark, sf_dir, "file_groups").select(F.col("id").alias("gid"), F.col("name").alias("group"))
    s = table(spark, sf_dir, "log_sources").join(g, F.col("file_group_id") == F.col("gid"))
    return s.groupBy("group").agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_list("file_path")), " ").alias("files"))


# Mining --------------------------------------------------------------------------------------------------------------


def _mined(spark, sf_dir, drain: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    tokens = _event_tokens(spark, sf_dir)
    vectors = mining.distinct_vectors(tokens)
    templates = mining.fold_templates(vectors) if drain else mining.strict_templates(vectors)
    return tokens, templates, mining.mined_patterns(templates)


@query(f'WITH {_MINED} SELECT "group", template, occurrence_count FROM p')
def mine_templates_strict(spark, sf_dir):
    return _mined(spark, sf_dir)[2].select("group", "template", "occurrence_count")


@query(f'WITH {_MINED} SELECT "group", template, occurrence_count FROM p')
def mine_templates_drain(spark, sf_dir):
    return _mined(spark, sf_dir, drain=True)[2].select("group", "template", "occurrence_count")


_STRICT = """(SELECT "group", size, pinned, i, CASE WHEN min(x) = max(x) THEN min(x) ELSE '<*>' END AS x FROM
  (SELECT "group", size, pinned, unnest(t) AS x, unnest(range(1, size + 1)) AS i FROM v) GROUP BY ALL)"""
_DOC_STRICT = f"""{_DOC_TOKENS}, v AS (SELECT "group", {_MASKED} AS t, len(k) AS size, array_to_string(({_MASKED})[1:14], ' ') AS pinned FROM l WHERE len(k) > 0),
 c AS (SELECT "group", size, pinned, count(*) n FROM v GROUP BY ALL),
 w AS (SELECT "group", size, pinned, string_agg(x, ' ' ORDER BY i) AS template FROM {_STRICT} GROUP BY ALL)
 SELECT "group", template, sum(n)::BIGINT AS occurrence_count FROM c JOIN w USING ("group", size, pinned) GROUP BY ALL"""


@query(f"WITH {_DOC_STRICT}")
def mine_documents_strict(spark, sf_dir):
    """As mine_documents_drain without any order; pinned tokens tell templates of one length apart."""
    tokens = mining.tokenized(document_lines(spark, sf_dir), "group", "source", "byte_offset", "line")
    vectors = mining.distinct_vectors(tokens)
    return mining.mined_patterns(mining.strict_templates(vectors)).select("group", "template", "occurrence_count")


@query(f"""WITH l AS {EVOLVING_LINES_SQL}, k AS (SELECT "group", family, {_TOKENS} AS k FROM l), m AS (SELECT "group", family, {_MASKED} AS t FROM k),
 v AS (SELECT "group", family, len(t) AS size, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS i FROM m),
 w AS (SELECT "group", family, i, CASE WHEN min(x) = max(x) THEN min(x) ELSE '<*>' END AS x FROM v GROUP BY ALL),
 a AS (SELECT "group", family, string_agg(x, ' ' ORDER BY i) AS template FROM w GROUP BY ALL),
 c AS (SELECT "group", family, count(*) AS occurrence_count FROM m GROUP BY ALL)
 SELECT "group", template, occurrence_count FROM a JOIN c USING ("group", family)""")
def mine_templates_evolving(spark, sf_dir):
    """Lines of 40 tokens of which the first 14 are the same: every leaf holds several templates, each of which evolves."""
    tokens = mining.tokenized(evolving_lines(spark, sf_dir), "group", "source", "byte_offset", "line")
    vectors = mining.distinct_vectors(tokens)
    return mining.mined_patterns(mining.fold_templates(vectors)).select("group", "template", "occurrence_count")


@query()
def mine_documents_drain(spark, sf_dir):
    """Templates of the document lines per language, many of them beyond 28 tokens."""
    tokens = mining.tokenized(document_lines(spark, sf_dir), "group", "source", "byte_offset", "line")
    vectors = mining.distinct_vectors(tokens)
    return mining.mined_patterns(mining.fold_templates(vectors)).select("group", "template", "occurrence_count")


@query(f'WITH {_MINED} SELECT "group", template, occurrence_count FROM p ORDER BY occurrence_count DESC, "group", template LIMIT 100')
def top_patterns(spark, sf_dir):
    p = _mined(spark, sf_dir)[2].select("group", "template", "occurrence_count")
    return p.orderBy(F.desc("occurrence_count"), "group", "template").limit(100)


_VARS = "list_transform(list_filter(range(1, len(k) + 1), lambda i: t[i] = '<*>'), lambda i: k[i])"


@query(f"""WITH {_MINED} SELECT "group", source, byte_offset, array_to_string(t, ' ') AS template,
 epoch(strptime(substr(line, 1, 19), '%Y-%m-%d %H:%M:%S'))::BIGINT AS entry_timestamp, array_to_string({_VARS}, chr(9)) AS variables FROM m""")
def mined_occurrences(spark, sf_dir):
    tokens, templates, _ = _mined(spark, sf_dir)
    o = mining.mined_occurrences(tokens, templates)
    return o.select("group", "source", "byte_offset", "template", "entry_timestamp", joined("variables", "\t").alias("variables"))


@query(f"SELECT byte_offset, line AS text FROM {EVENT_LINES_SQL}")
def reconstruct(spark, sf_dir):
    tokens, templates, _ = _mined(spark, sf_dir)
    o = mining.mined_occurrences(tokens, templates)
    return o.select("byte_offset", tk.reconstruct(F.col("template"), F.col("variables")).alias("text"))


@query(r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(template, '[ \t\f\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^ | $', '', 'g') AS template
 FROM patterns""")
def template_round_trip(spark, sf_dir):
    """Templates parsed into tokens and rendered again."""
    return table(spark, sf_dir, "patterns").select("id", tk.render(tk.parse_template(F.col("template"))).alias("template"))


# Ranking and reports -------------------------------------------------------------------------------------------------


def _model(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """patterns, file_groups, occurrences, log_sources"""
    return tuple(table(spark, sf_dir, t) for t in ("patterns", "file_groups", "occurrences", "log_sources"))


_RANKED = """SELECT p.id AS pattern_id, g.name AS "group", p.template, p.occurrence_count FROM patterns p
 JOIN file_groups g ON g.id = p.file_group_id WHERE p.occurrence_count > 0"""


@query(_RANKED + " ORDER BY p.occurrence_count DESC, p.id LIMIT 100")
def ranked_patterns(spark, sf_dir):
    return rank.ranked(table(spark, sf_dir, "patterns"), table(spark, sf_dir, "file_groups"), 100)


@query(_RANKED + " AND (p.template ILIKE '%timeout%' OR p.template ILIKE '%lost_%' OR p.template ILIKE '%<*>%at%')")
def like_filter(spark, sf_dir):
    return rank.ranked(table(spark, sf_dir, "patterns"), table(spark, sf_dir, "file_groups"), None, ["timeout", "lost_", "<*>%at"])


@query(_RANKED + " AND regexp_matches(g.name, '^[a-m]')")
def ranked_filter_group(spark, sf_dir):
    """The groups whose names begin with a letter of the first half of the alphabet."""
    names = [r["name"] for r in table(spark, sf_dir, "file_groups").where(F.col("name").rlike("^[a-m]")).collect()]  # file groups only
    return rank.ranked(table(spark, sf_dir, "patterns"), table(spark, sf_dir, "file_groups"), None, None, names)


@query("""SELECT (SELECT count(*) FROM patterns) AS n_patterns, (SELECT coalesce(sum(occurrence_count), 0)::BIGINT FROM patterns) AS n_occurrences,
 (SELECT count(*) FROM log_sources) AS n_sources""")
def report_summary(spark, sf_dir):
    return rank.summary(table(spark, sf_dir, "patterns"), table(spark, sf_dir, "log_sources"))


@query("""SELECT g.name AS "group", count(p.id) AS n_patterns, coalesce(sum(p.occurrence_count), 0)::BIGINT AS n_occurrences
 FROM file_groups g LEFT JOIN patterns p ON p.file_group_id = g.id GROUP BY g.name""")
def stats_by_group(spark, sf_dir):
    return rank.by_group(table(spark, sf_dir, "file_groups"), table(spark, sf_dir, "patterns"), False)


@query("""SELECT g.name AS "group", count(p.id) AS n_patterns, coalesce(sum(p.occurrence_count), 0)::BIGINT AS n_occurrences
 FROM file_groups g LEFT JOIN patterns p ON p.file_group_id = g.id AND p.occurrence_count > 0 GROUP BY g.name""")
def report_groups(spark, sf_dir):
    return rank.by_group(table(spark, sf_dir, "file_groups"), table(spark, sf_dir, "patterns"), True)


@query("""SELECT g.name AS "group", count(*) AS n_sources FROM log_sources s JOIN file_groups g ON g.id = s.file_group_id GROUP BY g.name""")
def sources_per_group(spark, sf_dir):
    return rank.sources_per_group(table(spark, sf_dir, "log_sources"), table(spark, sf_dir, "file_groups"))


@query("""SELECT pattern_id, log_source_id, regexp_extract(s.file_path, '[^/]+$') AS source, count(*) AS n
 FROM occurrences o JOIN log_sources s ON s.id = o.log_source_id GROUP BY ALL""")
def pattern_distribution(spark, sf_dir):
    return rank.distribution(table(spark, sf_dir, "occurrences"), table(spark, sf_dir, "log_sources"))


_SECONDS = """CASE WHEN entry_timestamp >= 946684800 AND entry_timestamp < 4102444800 THEN entry_timestamp
 WHEN entry_timestamp >= 946684800000 AND entry_timestamp < 4102444800000 THEN entry_timestamp // 1000
 WHEN entry_timestamp >= 946684800000000 AND entry_timestamp < 4102444800000000 THEN entry_timestamp // 1000000
 WHEN entry_timestamp >= 946684800000000000 AND entry_timestamp < 4102444800000000000 THEN entry_timestamp // 1000000000 END"""
_TIMED = f"t AS (SELECT id, pattern_id, {_SECONDS} AS s FROM occurrences)"


def _series(bucket: str):
    return lambda spark, sf_dir: rank.time_series(table(spark, sf_dir, "occurrences"), bucket)


_HOUR, _DAY = (f"strftime(make_timestamp(s * 1000000), '{f}')" for f in ("%Y-%m-%d %H:00", "%Y-%m-%d"))
_AUTO = f"CASE WHEN (SELECT max(s) - min(s) FROM t) < 172800 THEN {_HOUR} ELSE {_DAY} END"
for _name, _label in (("hour", _HOUR), ("day", _DAY), ("auto", _AUTO)):
    QUERIES[f"time_series_{_name}"] = _series(_name)
    SQL[f"time_series_{_name}"] = (
        f"WITH {_TIMED} SELECT pattern_id, {_label} AS bucket, count(*) AS n FROM t WHERE s IS NOT NULL GROUP BY ALL"
    )


@query(f"WITH {_TIMED} SELECT min(s) AS first_ts, max(s) AS last_ts FROM t")
def time_range(spark, sf_dir):
    return rank.time_range(table(spark, sf_dir, "occurrences"))


_SAMPLES = """r AS (SELECT id, pattern_id, log_source_id, variables,
  row_number() OVER (PARTITION BY pattern_id ORDER BY log_source_id, byte_offset, id) AS rank FROM occurrences WHERE variables <> ''),
 x AS (SELECT r.pattern_id, r.rank, regexp_extract(s.file_path, '[^/]+$') AS source, string_split(p.template, '<*>') AS f,
  string_split(r.variables, chr(9)) AS v FROM r JOIN patterns p ON p.id = r.pattern_id JOIN log_sources s ON s.id = r.log_source_id WHERE r.rank <= 5),
 samples AS (SELECT pattern_id, rank, source, array_to_string(list_transform(range(1, len(f) + 1),
  lambda i: f[i] || CASE WHEN i = len(f) THEN '' WHEN i <= len(v) THEN v[i] ELSE '<*>' END), '') AS text FROM x)"""


@query(f"WITH {_SAMPLES} SELECT pattern_id, rank, text, source FROM samples")
def pattern_samples(spark, sf_dir):
    p, _, o, s = _model(spark, sf_dir)
    return rank.samples(o, p, s)


@query(f"""WITH {_SAMPLES}, b AS ({_RANKED} ORDER BY p.occurrence_count DESC, p.id LIMIT 500),
 t AS (SELECT DISTINCT pattern_id FROM tags WHERE tag IN ('suppress', 'ignore')),
 a AS (SELECT pattern_id, max(CASE WHEN rank = 1 THEN text END) s1, max(CASE WHEN rank = 2 THEN text END) s2,
  max(CASE WHEN rank = 3 THEN text END) s3 FROM samples GROUP BY pattern_id)
 SELECT b.pattern_id AS id, b."group", b.template, b.occurrence_count, coalesce(s1, '') AS sample_1, coalesce(s2, '') AS sample_2,
  coalesce(s3, '') AS sample_3 FROM b LEFT JOIN a USING (pattern_id) WHERE b.pattern_id NOT IN (SELECT pattern_id FROM t)""")
def export_rows(spark, sf_dir):
    from strataloom.operators.export import export_rows as rows

    p, g, o, s = _model(spark, sf_dir)
    return rows(p, g, o, s, tags.suppressed(table(spark, sf_dir, "tags")), top=500, n_samples=3)


@query(f"""WITH {_SAMPLES}, b AS ({_RANKED} ORDER BY p.occurrence_count DESC, p.id LIMIT 500),
 a AS (SELECT pattern_id, count(*) n FROM samples GROUP BY ALL),
 d AS (SELECT pattern_id, count(DISTINCT log_source_id) n FROM occurrences o JOIN log_sources s ON s.id = o.log_source_id GROUP BY ALL),
 {_TIMED}, h AS (SELECT pattern_id, count(DISTINCT s // 86400) n FROM t WHERE s IS NOT NULL GROUP BY ALL),
 q AS (SELECT pattern_id, string_agg(DISTINCT tag, ',' ORDER BY tag) tags FROM tags GROUP BY ALL)
 SELECT b.*, coalesce(a.n, 0) AS n_samples, coalesce(d.n, 0) AS n_sources, coalesce(h.n, d.n, 0) AS n_buckets, coalesce(q.tags, '') AS tags
 FROM b LEFT JOIN a USING (pattern_id) LEFT JOIN d USING (pattern_id) LEFT JOIN h USING (pattern_id) LEFT JOIN q USING (pattern_id)""")
def report_rows(spark, sf_dir):
    p, g, o, s = _model(spark, sf_dir)
    r = rank.report(p, g, o, s, table(spark, sf_dir, "tags"), bucket="day")
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0))
    return r.select(
        "pattern_id", "group", "template", "occurrence_count", size(F.col("samples")).alias("n_samples"),
        size(F.col("distribution")).alias("n_sources"), size(F.col("trend")).alias("n_buckets"),
        F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"),
    )


@query("""SELECT s.id, s.file_path, g.name AS "group", coalesce(s.last_processed_position, 0) AS position FROM log_sources s
 JOIN file_groups g ON g.id = s.file_group_id""")
def source_positions(spark, sf_dir):
    g = table(spark, sf_dir, "file_groups").select(F.col("id").alias("gid"), F.col("name").alias("group"))
    s = table(spark, sf_dir, "log_sources").join(g, F.col("file_group_id") == F.col("gid"))
    return s.select("id", "file_path", "group", F.coalesce("last_processed_position", F.lit(0)).alias("position"))


# Anomalies, differences, gates ---------------------------------------------------------------------------------------

_SCORED = """c AS (SELECT p.id, g.name AS "group", p.template, coalesce(p.occurrence_count, 0) AS n, p.file_group_id AS fg
  FROM patterns p JOIN file_groups g ON g.id = p.file_group_id {0}),
 f AS (SELECT file_group_id AS fg, count(*) AS k FROM log_sources GROUP BY ALL),
 o AS (SELECT pattern_id AS id, count(DISTINCT log_source_id) AS seen FROM occurrences GROUP BY ALL),
 w AS (SELECT c.*, avg(n) OVER (PARTITION BY c.fg) AS mu, stddev_pop(n) OVER (PARTITION BY c.fg) AS sd,
  coalesce(k, 0) > 1 AND coalesce(seen, 1) = 1 AS lonely FROM c LEFT JOIN f ON f.fg = c.fg LEFT JOIN o ON o.id = c.id),
 z AS (SELECT *, coalesce(CASE WHEN sd > 0 THEN (n - mu) / sd END, 0) AS z FROM w),
 a AS (SELECT id AS pattern_id, "group", n AS occurrence_count, round(CASE WHEN lonely THEN 2.0 ELSE 0.0 END + CASE WHEN z > 3 THEN z ELSE 0 END, 6) AS score
  FROM z WHERE lonely OR z > 3)"""


def _anomalies(spark, sf_dir, suppress: bool, top: int | None) -> DataFrame:
    p, g, o, s = _model(spark, sf_dir)
    gone = tags.suppressed(table(spark, sf_dir, "tags")) if suppress else None
    return compare.anomalies(p, g, o, s, top, gone).withColumn("score", F.round("score", 6))


@query(f"WITH {_SCORED.format('')} SELECT * FROM a")
def anomalies(spark, sf_dir):
    return _anomalies(spark, sf_dir, False, None).select("pattern_id", "group", "occurrence_count", "score")


_NOT_SUPPRESSED = "WHERE p.id NOT IN (SELECT pattern_id FROM tags WHERE tag IN ('suppress', 'ignore'))"


@query(f"WITH {_SCORED.format(_NOT_SUPPRESSED)} SELECT * FROM a ORDER BY score DESC, pattern_id LIMIT 50")
def anomalies_suppressed(spark, sf_dir):
    return _anomalies(spark, sf_dir, True, 50).select("pattern_id", "group", "occurrence_count", "score")


#: The instant that separates the two snapshots compared.
SPLIT = 1_767_225_600


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counts of all patterns before 2026 and from then on; patterns not seen on a side aren't in its snapshot."""
    o = table(spark, sf_dir, "occurrences").select("pattern_id", rank.seconds(F.col("entry_timestamp")).alias("s"))
    p = table(spark, sf_dir, "patterns").select(F.col("id"), "file_group_id", "template")

    def side(rows: DataFrame) -> DataFrame:
        n = rows.groupBy("pattern_id").agg(F.count("*").alias("occurrence_count"))
        return compare.snapshot(p.join(n, F.col("id") == F.col("pattern_id")), table(spark, sf_dir, "file_groups"))

    return side(o.where(F.col("s") < SPLIT)), side(o.where(F.col("s") >= SPLIT))


_SIDES = f"""{_TIMED}, n AS (SELECT g.name AS "group", p.template, count(*) FILTER (WHERE s < {SPLIT}) AS b, count(*) FILTER (WHERE s >= {SPLIT}) AS a
 FROM t JOIN patterns p ON p.id = t.pattern_id JOIN file_groups g ON g.id = p.file_group_id GROUP BY ALL)"""


def _diff(kind: str):
    def run(spark, sf_dir):
        d = compare.diff(*snapshots(spark, sf_dir)).where(F.col("kind") == kind)
        return d.select("group", "template", "before_count", "after_count", "delta")

    return run


for _name, _cond in (("new", "b = 0 AND a > 0"), ("resolved", "a = 0 AND b > 0"), ("changed", "a > 0 AND b > 0 AND (a > 2 * b OR 2 * a < b)")):
    QUERIES[f"diff_{_name}"] = _diff(_name)
    SQL[f"diff_{_name}"] = f'WITH {_SIDES} SELECT "group", template, b AS before_count, a AS after_count, a - b AS delta FROM n WHERE {_cond}'


@query(f"""WITH {_SIDES} SELECT CASE WHEN b = 0 THEN 'new' WHEN a = 0 THEN 'resolved' ELSE 'changed' END AS kind, count(*) AS n,
 sum(a - b)::BIGINT AS delta FROM n WHERE (b = 0 AND a > 0) OR (a = 0 AND b > 0) OR (a > 0 AND b > 0 AND (a > 2 * b OR 2 * a < b)) GROUP BY kind""")
def baseline_compare(spark, sf_dir):
    from strataloom.operators.export import read_baseline, save_baseline
    from strataloom.session import scratch

    before, after = snapshots(spark, sf_dir)
    path = scratch(spark, "baseline")
    save_baseline(before, path)
    return compare.diff(read_baseline(spark, path), after).groupBy("kind").agg(F.count("*").alias("n"), F.sum("delta").alias("delta"))


@query(f"""WITH {_SCORED.format('')}, {_SIDES} SELECT 'max anomaly score' AS name, 12.0::DOUBLE AS threshold, round(coalesce(max(score), 0), 6) AS actual,
  coalesce(max(score), 0) <= 12 AS passed FROM a
 UNION ALL SELECT 'max new patterns', 5.0::DOUBLE, count(*)::DOUBLE, count(*) <= 5 FROM n WHERE b = 0 AND a > 0
 UNION ALL SELECT 'no pattern contains ''OutOfMemory''', 0.0::DOUBLE, count(*)::DOUBLE, count(*) = 0 FROM patterns WHERE contains(template, 'OutOfMemory')
 UNION ALL SELECT 'no pattern contains ''Timeout''', 0.0::DOUBLE, count(*)::DOUBLE, count(*) = 0 FROM patterns WHERE contains(template, 'Timeout')""")
def check_gate(spark, sf_dir):
    scores = _anomalies(spark, sf_dir, False, None)
    return compare.gate(
        scores, compare.diff(*snapshots(spark, sf_dir)), table(spark, sf_dir, "patterns"), 12.0, 5, ("OutOfMemory", "Timeout")
    )


# Pairs, clusters, search ---------------------------------------------------------------------------------------------

def _plain_templates(spark, sf_dir) -> DataFrame:
    return dedup.template_tokens(table(spark, sf_dir, "patterns"))


_BRACKETED = r"[(\[](?:[^()\[\]]|[(\[][^()\[\]]*[)\]])*[)\]]"
_TOKEN_ROWS = f"""k AS (SELECT id, file_group_id g, regexp_extract_all(replace(template, chr(10), ' '),
 '(?:[^ \\t\\f\\r()\\[\\]]|{_BRACKETED})+') AS k FROM patterns)"""


@query(f"""WITH {_TOKEN_ROWS}, n AS (SELECT g, count(*) n FROM k WHERE len(k) > 0 GROUP BY g),
 u AS (SELECT g, id, unnest(list_distinct(k)) AS token FROM k), d AS (SELECT g, token, count(*) df FROM u WHERE token <> '<*>' GROUP BY ALL)
 SELECT d.g AS "group", token, df, round(CASE WHEN df / n > 0.8 THEN ln(n / df) * 0.1 ELSE ln(n / df) END, 6) AS idf
 FROM d JOIN n ON n.g IS NOT DISTINCT FROM d.g""")
def idf(spark, sf_dir):
    return dedup.idf(_plain_templates(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


_VECTORS = f"""{_TOKEN_ROWS}, n AS (SELECT g, count(*) n FROM k WHERE len(k) > 0 GROUP BY g), u AS (SELECT g, id, len(k) l, unnest(k) AS token FROM k),
 f AS (SELECT g, id, l, token, count(*) c FROM u WHERE token <> '<*>' GROUP BY ALL), d AS (SELECT g, token, count(*) df FROM f GROUP BY ALL),
 v AS (SELECT f.g, id, f.token, c / l * CASE WHEN df / n > 0.8 THEN ln(n / df) * 0.1 ELSE ln(n / df) END AS w FROM f
  JOIN d ON d.g = f.g AND d.token = f.token JOIN n ON n.g = f.g), s AS (SELECT id, sqrt(sum(w * w)) AS z FROM v GROUP BY id),
 p AS (SELECT x.id a, y.id b, sum(x.w * y.w) / any_value(sx.z * sy.z) AS c FROM v x JOIN v y ON x.g = y.g AND x.token = y.token AND x.id < y.id
  JOIN s sx ON sx.id = x.id JOIN s sy ON sy.id = y.id WHERE sx.z > 0 AND sy.z > 0 GROUP BY x.id, y.id)"""


@query(f"WITH {_VECTORS} SELECT a, b, round(c, 6) AS similarity FROM p WHERE c >= 0.8")
def cosine_pairs(spark, sf_dir):
    return dedup.semantic_pairs(_plain_templates(spark, sf_dir), 0.8).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_TOKEN_ROWS}, p AS (SELECT x.id a, y.id b, len(x.k) n, len(list_filter(range(1, len(x.k) + 1),
  lambda i: x.k[i] = y.k[i] OR x.k[i] = '<*>' OR y.k[i] = '<*>')) m FROM k x JOIN k y ON x.g = y.g AND len(x.k) = len(y.k) AND x.id < y.id WHERE len(x.k) > 0)
 SELECT a, b, round(m / n, 6) AS similarity FROM p WHERE m / n >= 0.8""")
def structural_pairs(spark, sf_dir):
    return dedup.structural_pairs(_plain_templates(spark, sf_dir), 0.8).withColumn("similarity", F.round("similarity", 6))


# labels spread along pairs (e: a, b in both directions) until each is the least of its component
_LABELS = """e AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
 h(id, l) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, h.l FROM h JOIN e ON e.a = h.id WHERE h.l < e.b),
 m AS (SELECT id, min(l) AS component FROM h GROUP BY id)"""
_CLASSES = """SELECT id, component, n_links FROM m JOIN (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a) USING (id)"""
_ALIKE = f"""{_TOKEN_ROWS}, q AS (SELECT x.id a, y.id b FROM k x JOIN k y ON x.g = y.g AND len(x.k) = len(y.k) AND x.id < y.id WHERE len(x.k) > 0
  AND len(list_filter(range(1, len(x.k) + 1), lambda i: x.k[i] = y.k[i] OR x.k[i] = '<*>' OR y.k[i] = '<*>')) / len(x.k) >= 0.95)"""


@query(f"WITH RECURSIVE {_ALIKE}, {_LABELS} {_CLASSES}")
def dedup_structural(spark, sf_dir):
    return dedup.duplicate_classes(table(spark, sf_dir, "patterns"), "structural", 0.95)


def _semantic(threshold: float):
    return lambda spark, sf_dir: dedup.duplicate_classes(table(spark, sf_dir, "patterns"), "semantic", threshold)


# the command's default, which few templates of these tables reach, and a lower one
for _name, _threshold in (("dedup_semantic", 0.95), ("dedup_semantic_loose", 0.8)):
    QUERIES[_name] = _semantic(_threshold)
    SQL[_name] = f"WITH RECURSIVE {_VECTORS}, q AS (SELECT a, b FROM p WHERE c >= {_threshold} - 1e-9), {_LABELS} {_CLASSES}"


@query(f"""WITH {_TIMED}, e AS (SELECT t.id, t.pattern_id p, q.file_group_id g, s FROM t JOIN patterns q ON q.id = t.pattern_id WHERE s IS NOT NULL AND q.occurrence_count >= 10),
 c AS (SELECT p, count(*) c FROM e GROUP BY p), z AS (SELECT greatest(max(s) - min(s), 1) z FROM e),
 l AS (SELECT least(x.p, y.p) a, greatest(x.p, y.p) b, y.s - x.s lag FROM e x JOIN e y ON y.s >= x.s AND y.s <= x.s + 60 AND x.g <> y.g
  AND (y.s > x.s OR x.p < y.p)),
 o AS (SELECT a, b, count(*) observed, list_sort(list(lag)) lags FROM l GROUP BY a, b),
 r AS (SELECT a, b, observed, ca.c * cb.c * 60.0 / z AS expected, lags[len(lags) // 2 + 1] AS median_lag FROM o JOIN c ca ON ca.p = a JOIN c cb ON cb.p = b, z)
 SELECT a, b, observed, round(expected, 6) AS expected, round(observed / expected, 6) AS confidence, median_lag FROM r
 WHERE observed >= 3 AND observed / expected >= 1.5 ORDER BY observed / expected DESC, a, b LIMIT 20""")
def correlations(spark, sf_dir):
    c = correlate.correlations(table(spark, sf_dir, "occurrences"), table(spark, sf_dir, "patterns"))
    return c.withColumn("expected", F.round("expected", 6)).withColumn("confidence", F.round("confidence", 6))


_INDEX = """top AS (SELECT id FROM patterns ORDER BY occurrence_count DESC NULLS LAST, id LIMIT 200),
 y AS (SELECT DISTINCT pattern_id p, trim(unnest(string_split(variables, chr(9)))) v FROM occurrences WHERE variables <> '' AND pattern_id IN (SELECT id FROM top)),
 x AS (SELECT p, v FROM y WHERE strlen(v) > 1 AND NOT (strlen(v) < 5 AND regexp_full_match(v, '[0-9]+') AND coalesce(try_cast(v AS INT), 0) < 1000)),
 k AS (SELECT v FROM x GROUP BY v HAVING count(*) BETWEEN 2 AND (SELECT greatest(count(DISTINCT p) // 2, 2) FROM x))"""


_INDEX_ALL = _INDEX.replace(" ORDER BY occurrence_count DESC NULLS LAST, id LIMIT 200", "")


@query(f"WITH {_INDEX} SELECT x.p AS a, z.p AS b, count(*) AS shared FROM x JOIN x z ON z.v = x.v AND x.p < z.p JOIN k ON k.v = x.v GROUP BY ALL HAVING count(*) >= 3")
def shared_value_pairs(spark, sf_dir):
    """Parity with the reference's command, whose default are the 200 patterns of the highest stored counts."""
    index = correlate.variable_index(table(spark, sf_dir, "occurrences"), table(spark, sf_dir, "patterns"), 200)
    return correlate.shared_value_pairs(correlate.shared_values(index))


@query(f"WITH {_INDEX_ALL} SELECT x.p AS a, z.p AS b, count(*) AS shared FROM x JOIN x z ON z.v = x.v AND x.p < z.p JOIN k ON k.v = x.v GROUP BY ALL HAVING count(*) >= 3")
def shared_value_pairs_all(spark, sf_dir):
    """Pairs among all patterns."""
    index = correlate.variable_index(table(spark, sf_dir, "occurrences"), table(spark, sf_dir, "patterns"))
    return correlate.shared_value_pairs(correlate.shared_values(index))


@query(f"""WITH RECURSIVE {_INDEX_ALL}, q AS (SELECT x.p AS a, z.p AS b FROM x JOIN x z ON z.v = x.v AND x.p < z.p JOIN k ON k.v = x.v GROUP BY ALL HAVING count(*) >= 3),
 {_LABELS}, o AS (SELECT component, v FROM x JOIN k USING (v) JOIN m ON m.id = x.p GROUP BY component, v HAVING count(*) >= 2),
 s AS (SELECT component, v, row_number() OVER (PARTITION BY component ORDER BY v) AS r FROM o), w AS (SELECT component, string_agg(v, '|' ORDER BY v) AS "values" FROM s WHERE r <= 10 GROUP BY ALL)
 SELECT component AS cluster, count(*) AS n_patterns, string_agg(id, ',' ORDER BY id) AS patterns, any_value("values") AS "values"
 FROM m LEFT JOIN w USING (component) GROUP BY component ORDER BY n_patterns DESC, cluster LIMIT 20""")
def cluster_shared_vars(spark, sf_dir):
    c = correlate.clusters(table(spark, sf_dir, "occurrences"), table(spark, sf_dir, "patterns"))
    return c.select("cluster", "n_patterns", F.array_join(F.transform("patterns", lambda x: x.cast("string")), ",").alias("patterns"), F.array_join("values", "|").alias("values"))


_TERM_LIST = "regexp_extract_all(lower(template), '[\\p{L}\\p{N}]+')"


@query(f"SELECT id AS pattern_id, template FROM patterns WHERE list_has_all({_TERM_LIST}, ['timeout', 'reply'])")
def search_and(spark, sf_dir):
    return search.search(table(spark, sf_dir, "patterns"), "Timeout reply")


@query(f"SELECT id AS pattern_id, template FROM patterns WHERE contains(' ' || array_to_string({_TERM_LIST}, ' ') || ' ', ' timeout while reading ')")
def search_phrase(spark, sf_dir):
    return search.search(table(spark, sf_dir, "patterns"), '"timeout while reading"')


@query(f"SELECT id AS pattern_id, template FROM patterns WHERE len(list_filter({_TERM_LIST}, lambda x: starts_with(x, 'sched'))) > 0")
def search_prefix(spark, sf_dir):
    return search.search(table(spark, sf_dir, "patterns"), "sched*")


@query(f"""SELECT id AS pattern_id, template FROM patterns WHERE (list_contains({_TERM_LIST}, 'lost') OR list_contains({_TERM_LIST}, 'failed'))
 AND NOT list_contains({_TERM_LIST}, 'channel')""")
def search_boolean(spark, sf_dir):
    return search.search(table(spark, sf_dir, "patterns"), "(lost OR failed) NOT channel")


@query(f"SELECT DISTINCT id AS key, unnest({_TERM_LIST}) AS term FROM patterns")
def inverted_index(spark, sf_dir):
    return search.inverted_index(table(spark, sf_dir, "patterns"), "id", "template")


@query(r"""WITH b AS (SELECT b.*, row_number() OVER (ORDER BY confidence DESC, a, b) r FROM (""" + SQL["correlations"] + r""") b),
 t AS (SELECT p.id, g.name, regexp_replace(template, '\s*\n\s*', ' ', 'g') x FROM patterns p LEFT JOIN file_groups g ON g.id = p.file_group_id)
 SELECT a, b, x.name AS group_a, CASE WHEN length(x.x) <= 80 THEN x.x ELSE substr(x.x, 1, 77) || '...' END AS template_a,
  y.name AS group_b, CASE WHEN length(y.x) <= 80 THEN y.x ELSE substr(y.x, 1, 77) || '...' END AS template_b FROM b JOIN t x ON x.id = a JOIN t y ON y.id = b""")
def correlations_described(spark, sf_dir):
    """The strongest correlations with the groups and the beginnings of the templates."""
    p, g, o, _ = _model(spark, sf_dir)
    return correlate.described(correlate.correlations(o, p), p, g).select("a", "b", "group_a", "template_a", "group_b", "template_b")


@query("SELECT id AS pattern_id, template FROM patterns WHERE len(list_filter(range(1, len({0}) + 1), lambda i: ({0})[i] = 'timeout' AND list_contains(({0})[i + 1:i + 6], 'reply') OR ({0})[i] = 'reply' AND list_contains(({0})[i + 1:i + 6], 'timeout'))) > 0".format(_TERM_LIST))
def search_near(spark, sf_dir):
    """Two terms with at most five others between them."""
    return search.search(table(spark, sf_dir, "patterns"), "template: NEAR(timeout reply, 5)")


# Exports -------------------------------------------------------------------------------------------------------------


@query(f"""SELECT id || ',' || CASE WHEN regexp_matches(template, '[,"\n\r]') THEN '"' || replace(template, '"', '""') || '"' ELSE template END AS line FROM patterns""")
def csv_rows(spark, sf_dir):
    from strataloom.operators.export import csv_lines

    return csv_lines(table(spark, sf_dir, "patterns").select("id", "template"))


@query(f"""WITH {_SAMPLES}, b AS ({_RANKED} ORDER BY p.occurrence_count DESC, p.id LIMIT 500)
 SELECT b.pattern_id AS id, b."group", b.template, b.occurrence_count, coalesce(string_agg(source || ': ' || text, chr(10) ORDER BY rank), '') AS samples
 FROM b LEFT JOIN samples USING (pattern_id) GROUP BY ALL""")
def export_samples(spark, sf_dir):
    """The nested export with its samples as lines."""
    from strataloom.operators.export import export_nested

    p, g, o, s = _model(spark, sf_dir)
    lines = F.array_join(F.transform("samples", lambda x: F.concat(x["source"], F.lit(": "), x["text"])), "\n")
    return export_nested(p, g, o, s).withColumn("samples", lines)


@query(f"""WITH {_SIDES} SELECT "group", template, printf('%+.0f%%', (a - b) * 100.0 / b) AS percent FROM n
 WHERE a > 0 AND b > 0 AND (a > 2 * b OR 2 * a < b)""")
def diff_percent(spark, sf_dir):
    return compare.diff(*snapshots(spark, sf_dir)).where("kind = 'changed'").select("group", "template", "percent")


# Tags and tickets ----------------------------------------------------------------------------------------------------


@query("SELECT pattern_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY pattern_id")
def tags_by_pattern(spark, sf_dir):
    return tags.tags_by_pattern(table(spark, sf_dir, "tags")).withColumn("tags", F.array_join("tags", ","))


@query("""SELECT id, template FROM patterns p WHERE occurrence_count >= 50 AND id IN (SELECT pattern_id FROM tags WHERE tag IN ('critical', 'known-issue'))
 AND id NOT IN (SELECT pattern_id FROM tags WHERE tag IN ('suppress', 'noise'))""")
def tag_filter(spark, sf_dir):
    kept = tags.select_patterns(
        table(spark, sf_dir, "patterns"), table(spark, sf_dir, "tags"), min_count=50, any_of=["critical", "known-issue"], none_of=["suppress", "noise"]
    )
    return kept.select("id", "template")


def _tickets(spark, sf_dir) -> DataFrame:
    """A ticket per tagged pattern; those tagged critical were written at a count one lower."""
    own = table(spark, sf_dir, "tags").groupBy("pattern_id").agg(F.max(F.lower("tag") == "critical").alias("old"))
    p = table(spark, sf_dir, "patterns").join(own, F.col("id") == F.col("pattern_id"))
    count = F.coalesce("occurrence_count", F.lit(0)) - F.when(F.col("old"), 1).otherwise(0)
    marker = tickets.build_marker(F.lit("main"), F.col("id"), F.greatest(count, F.lit(0)))
    return p.select(F.concat(F.lit("LOG-"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("Seen in production.\n"), marker).alias("description"))


_TICKETS = """k AS (SELECT pattern_id AS id, max(CASE WHEN lower(tag) = 'critical' THEN 1 ELSE 0 END) AS old FROM tags GROUP BY ALL),
 t AS (SELECT p.id, 'LOG-' || p.id AS key, greatest(coalesce(occurrence_count, 0) - old, 0) AS n FROM patterns p JOIN k ON k.id = p.id)"""


@query(f"WITH {_TICKETS} SELECT key, 'main' AS db, id AS pattern_id, n AS occurrences FROM t")
def marker_parse(spark, sf_dir):
    return tickets.ticket_map(_tickets(spark, sf_dir)).select("key", "db", "pattern_id", "occurrences")


@query(f"""WITH {_TICKETS} SELECT p.id AS pattern_id, p.occurrence_count, t.key,
 CASE WHEN t.key IS NULL THEN 'create' WHEN t.n = p.occurrence_count THEN 'unchanged' ELSE 'update' END AS action FROM patterns p LEFT JOIN t ON t.id = p.id""")
def ticket_plan(spark, sf_dir):
    planned = tickets.plan(table(spark, sf_dir, "patterns"), _tickets(spark, sf_dir), "main")
    return planned.select("pattern_id", "occurrence_count", "key", "action")


@query(f"""WITH {_TICKETS}, a AS (SELECT count(*) FILTER (WHERE occurrence_count > 0) AS total FROM patterns),
 b AS (SELECT count(*) AS with_ticket, count(*) FILTER (WHERE p.occurrence_count <> t.n) AS changed FROM t JOIN patterns p ON p.id = t.id)
 SELECT total, with_ticket, greatest(total - with_ticket, 0) AS new, changed FROM a, b""")
def ticket_status(spark, sf_dir):
    return tickets.status(table(spark, sf_dir, "patterns"), _tickets(spark, sf_dir), "main")


_FACTS = f"""{_TIMED}, s AS (SELECT pattern_id p, min(s) lo, max(s) hi FROM t WHERE s IS NOT NULL GROUP BY ALL),
 r AS (SELECT pattern_id p, replace(variables, chr(9), ' | ') v, row_number() OVER (PARTITION BY pattern_id ORDER BY log_source_id, byte_offset, id) r
  FROM occurrences WHERE variables <> ''), v AS (SELECT p, string_agg(v, chr(10) ORDER BY r) v FROM r WHERE r <= 5 GROUP BY p),
 f AS (SELECT p.id, template, coalesce(g.name, '') g, occurrence_count n, strftime(make_timestamp(lo * 1000000), '%Y-%m-%d %H:%M:%S UTC') lo,
  strftime(make_timestamp(hi * 1000000), '%Y-%m-%d %H:%M:%S UTC') hi, v FROM patterns p LEFT JOIN file_groups g ON g.id = p.file_group_id
  LEFT JOIN s ON s.p = p.id LEFT JOIN v ON v.p = p.id WHERE occurrence_count > 0)"""


@query(f"""WITH {_FACTS} SELECT id AS pattern_id, concat_ws(chr(10) || chr(10), 'h3. Pattern' || chr(10) || '{{noformat}}' || chr(10) || template || chr(10) || '{{noformat}}',
 concat_ws(chr(10), '*Occurrences:* ' || format('{{:,}}', n), '*First seen:* ' || lo, '*Last seen:* ' || hi, '*File group:* ' || g),
 'h3. Sample Log Lines' || chr(10) || '{{noformat}}' || chr(10) || v || chr(10) || '{{noformat}}',
 '{{code:title=pattern-marker}}' || chr(10) || 'pattern:db=main;pattern_id=' || id || ';occurrences=' || n || chr(10) || '{{code}}') AS description FROM f""")
def ticket_bodies(spark, sf_dir):
    p, g, o, _ = _model(spark, sf_dir)
    about = tickets.facts(p.where("occurrence_count > 0"), g, o)
    return tickets.body(about, "main").select("pattern_id", "description")


@query(f"""WITH {_FACTS} SELECT id AS pattern_id, '[pattern sync] Updated now' || chr(10) || '* Occurrences: ' || format('{{:,}}', n // 3) || ' -> ' || format('{{:,}}', n) || ' (+' ||
 format('{{:,}}', n - n // 3) || ')' || chr(10) || '* Last seen: ' || coalesce(hi, 'unknown') AS comment FROM f""")
def ticket_comments(spark, sf_dir):
    """What tickets are told whose patterns have three times the occurrences noted."""
    p, g, o, _ = _model(spark, sf_dir)
    about = tickets.facts(p.where("occurrence_count > 0"), g, o)
    noted = F.floor(F.col("occurrence_count") / 3)
    return about.select("pattern_id", tickets.change_comment(noted, F.col("occurrence_count"), F.col("last_seen"), F.lit("now")).alias("comment"))


# The store -----------------------------------------------------------------------------------------------------------


@query(f'WITH {_MINED} SELECT "group", template, occurrence_count FROM p')
def store_increments(spark, sf_dir):
    """The event log taken into a store in two steps, the later half of the month after the earlier, as a stream does."""
    from strataloom.session import scratch
    from strataloom.store import Store
    from strataloom.streaming.pipeline import step

    lines = event_lines(spark, sf_dir)
    half = lines.agg(F.floor((F.min("byte_offset") + F.max("byte_offset")) / 2)).first()[0]
    store = Store(spark, scratch(spark, "store"))
    step(store, lines.where(F.col("byte_offset") <= half), 0)
    step(store, lines.where(F.col("byte_offset") > half), 1, last=True)
    m = store.model()
    groups = m["file_groups"].select(F.col("id").alias("gid"), F.col("name").alias("group"))
    return m["patterns"].join(groups, F.col("file_group_id") == F.col("gid")).select("group", "template", "occurrence_count")


def _event_files(spark, sf_dir) -> str:
    """The event log written as three files; their paths."""
    from strataloom.session import scratch

    path = scratch(spark, "lines")
    event_lines(spark, sf_dir).select("line").repartition(3).write.text(path)
    return ",".join(re.sub("^file:/+", "/", f) for f in sorted(spark.read.text(path).inputFiles()))


@query(f"SELECT line, strlen(line) + 1 AS n_bytes FROM {EVENT_LINES_SQL}")
def scan_lines(spark, sf_dir):
    """Log files read as lines with byte offsets."""
    from strataloom.sources.logs import read_lines

    return read_lines(spark, _event_files(spark, sf_dir)).select("line", (F.col("next_offset") - F.col("byte_offset")).alias("n_bytes"))


@query(f"""WITH {_MINED} SELECT template, sum(occurrence_count)::BIGINT AS occurrence_count FROM p GROUP BY template""")
def stream_store(spark, sf_dir):
    """Log files followed as a stream until all is read, and the store that comes out."""
    from strataloom.session import scratch
    from strataloom.store import Store
    from strataloom.streaming.pipeline import finish, watch

    store = Store(spark, scratch(spark, "followed"))
    q = watch(spark, store, _event_files(spark, sf_dir), scratch(spark, "followed-state"), "events.log", trigger={"availableNow": True})
    q.awaitTermination()
    finish(store)
    return store.model()["patterns"].select("template", "occurrence_count")
