"""Queries of the general data-preparation operators, and their SQL where it is plain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import grammar
from strataloom.functions.instants import epoch_us
from strataloom.operators import balanced, clock, entries, incremental
from strataloom.session import scratch, table


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "occurrences").select("id", "pattern_id", "entry_timestamp")
    profile = balanced.per_key_profile(rows, "pattern_id", ["id"], epoch_us(F.col("entry_timestamp")))
    return balanced.against_stored(profile, table(spark, sf_dir, "patterns"), "pattern_id", "id", "occurrence_count")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_profile(spark, sf_dir).where("share >= 0.02 and pattern_id is not null").select("pattern_id")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_profile(spark, sf_dir).select(
        "pattern_id", "n_rows", "n_timed", "first_us", "last_us", "steps_back", "longest_step_us", "count_delta"
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.entries_to_process(
        spark,
        table(spark, sf_dir, "raw_entries"),
        table(spark, sf_dir, "log_sources"),
        table(spark, sf_dir, "source_scans"),
        scratch(spark, "incremental"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_entries")
    found = entries.parse_entries(raw, "log_source_id", "byte_offset", "raw_message", "id", with_text=False)
    return found.select("log_source_id", "byte_offset", "last_byte_offset", "log_level", "component")


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_entries")
    found = entries.parse_entries(raw, "log_source_id", "byte_offset", "raw_message", "id")
    return entries.match_patterns(found, table(spark, sf_dir, "patterns"), table(spark, sf_dir, "log_sources"))


def _text_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.text_instants(
        table(spark, sf_dir, "raw_entries"),
        "id",
        "log_source_id",
        "logged_at",
        "received_at",
        table(spark, sf_dir, "source_zones"),
        spark,
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = clock.number_instants(table(spark, sf_dir, "occurrences"), "id", "entry_timestamp").where("layout <> 's'")
    return (
        _text_instants(spark, sf_dir)
        .select(F.lit("raw_entries").alias("table_name"), "id", "utc_us")
        .unionByName(numbers.select(F.lit("occurrences").alias("table_name"), "id", "utc_us"))
    )


def p7_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_instants(spark, sf_dir)


_EPOCH = """CASE WHEN entry_timestamp >= 946684800 AND entry_timestamp < 4102444800 THEN entry_timestamp * 1000000
 WHEN entry_timestamp >= 946684800000 AND entry_timestamp < 4102444800000 THEN entry_timestamp * 1000
 WHEN entry_timestamp >= 946684800000000 AND entry_timestamp < 4102444800000000 THEN entry_timestamp
 WHEN entry_timestamp >= 946684800000000000 AND entry_timestamp < 4102444800000000000 THEN entry_timestamp // 1000 END"""

# one regular expression per layout, with level and component in either order of the groups
_STAMP = r"(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[T ][0-9:.,]+[^\]|)]*?|[0-9]{2}/[0-9]{2}/[0-9]{4}[^\])]*|[0-9]{2}[.][0-9]{2}[.][0-9]{4} [^;]*|[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[^\])]*|(?:[A-Z][a-z]{2}, )?[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [^;\])]*|[0-9]{10}(?:[.][0-9]+)?|[0-9]{13}|[0-9]{16}|[0-9]{19})"
_LEVEL = "(?i:trace|finest|debug|dbg|info|notice|warn|warning|error|err|severe|fatal|crit|critical|[TDIWEF]|[1-6]0)"
_PART = r"[\w.$/@-]+"
_LAYOUTS = [  # pattern, group of the level, group of the component
    (rf"^{_STAMP} \*({_LEVEL})\* \[[^\]]*\] ({_PART}) - ", 1, 2),
    (rf"^\[{_STAMP}\] ?\[ *({_LEVEL}) *\] ?\[({_PART}) *\] ", 1, 2),
    (rf"^\[{_STAMP}\] ?\[({_PART}) *\] ?\[ *({_LEVEL}) *\] ", 2, 1),
    (rf"^\[{_STAMP}\] ({_PART}) ({_LEVEL}): ", 2, 1),
    (rf"^({_PART}) \({_STAMP}\) ({_LEVEL}) >> ", 2, 1),
    (rf"^({_LEVEL}); {_STAMP}; ({_PART}); ", 1, 2),
    (rf"^[A-Z][a-z]{{2}} [ 0-9][0-9] [0-9:]{{8}} \S+ ({_PART})\[[0-9]+\]: (?:<({_LEVEL})> |\[({_LEVEL})\] |({_LEVEL}): )", (2, 3, 4), 1),
    (rf"^([TDIWEF])[0-9]{{4}} [0-9:.]+ +[0-9]+ ({_PART}):[0-9]+\] ", 1, 2),
    (rf"^{_STAMP} ?\| ?({_LEVEL}) *\| ?({_PART}) *\| ?", 1, 2),
    (rf"^{_STAMP} ({_LEVEL}) ({_PART}): ", 1, 2),
]


def _entries_sql() -> str:
    level, part = [], []
    for pattern, lv, co in _LAYOUTS:
        quoted = pattern.replace("'", "''")
        found = " || ".join(f"regexp_extract(h, '{quoted}', {g})" for g in (lv if isinstance(lv, tuple) else (lv,)))
        level.append(f"WHEN regexp_matches(h, '{quoted}') THEN {found}")
        part.append(f"WHEN regexp_matches(h, '{quoted}') THEN regexp_extract(h, '{quoted}', {co})")
    key = lambda names: f"coalesce({', '.join(names)})"
    inside = lambda names: key([f"""json_extract_string(j, '$."{n}"')""" for n in names])
    pair = lambda names: key(
        [rf"""nullif(trim(regexp_extract(m, '(?:^|\s){n}=("(?:[^"\\]|\\.)*"|[^\s"]+)', 1), '"'), '')""" for n in names]
    )
    ts, lv, co = (grammar.FIELD_NAMES[k].split() for k in ("ts", "lv", "co"))
    return rf"""WITH o AS (SELECT log_source_id s, byte_offset b, arg_min(raw_message, id) m FROM raw_entries
  WHERE log_source_id IS NOT NULL AND byte_offset IS NOT NULL GROUP BY ALL),
 r AS (SELECT s, b, m, regexp_extract(coalesce(m, ''), '^[^\n]*') h, CASE WHEN starts_with(m, '{{') AND json_valid(m) THEN m::JSON END j,
  regexp_matches(coalesce(m, ''), '^[@\w.-]+=\S') p FROM o),
 f AS (SELECT s, b, CASE WHEN j IS NOT NULL AND {inside(ts)} IS NOT NULL THEN {inside(lv)} WHEN p AND {pair(ts)} IS NOT NULL THEN {pair(lv)} {' '.join(level)} END lv,
  CASE WHEN j IS NOT NULL THEN {inside(co)} WHEN p THEN {pair(co)} {' '.join(part)} END co FROM r),
 l AS (SELECT s, b, trim(co) co, CASE upper(trim(lv)) WHEN 'FINEST' THEN 'TRACE' WHEN 'DBG' THEN 'DEBUG' WHEN 'NOTICE' THEN 'INFO' WHEN 'WARNING' THEN 'WARN'
   WHEN 'ERR' THEN 'ERROR' WHEN 'SEVERE' THEN 'ERROR' WHEN 'CRIT' THEN 'FATAL' WHEN 'CRITICAL' THEN 'FATAL' WHEN 'T' THEN 'TRACE' WHEN 'D' THEN 'DEBUG'
   WHEN 'I' THEN 'INFO' WHEN 'W' THEN 'WARN' WHEN 'E' THEN 'ERROR' WHEN 'F' THEN 'FATAL' WHEN '10' THEN 'TRACE' WHEN '20' THEN 'DEBUG'
   WHEN '30' THEN 'INFO' WHEN '40' THEN 'WARN' WHEN '50' THEN 'ERROR' WHEN '60' THEN 'FATAL' ELSE upper(trim(lv)) END lv FROM f),
 h AS (SELECT *, lv IS NOT NULL AND lv <> '' AND co IS NOT NULL AS head FROM l),
 e AS (SELECT *, sum(head::INT) OVER (PARTITION BY s ORDER BY b) e FROM h)
 SELECT s AS log_source_id, min(b) AS byte_offset, max(b) AS last_byte_offset, max(CASE WHEN head THEN lv END) AS log_level,
  max(CASE WHEN head THEN co END) AS component FROM e WHERE e > 0 GROUP BY s, e"""


_SHAPES = [  # layouts of logged_at with the groups of year, month, day, hour, minute, second, fraction, zone (0: none)
    (r"^([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)? ?([A-Za-z]+|[+-][0-9:]+)?(?:\[.*)?$", (1, 2, 3, 4, 5, 6, 7, 8)),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})(Z)?$", (1, 2, 3, 4, 5, 6, 0, 7)),
    (r"^([0-9]{2})/([A-Z][a-z]{2})/([0-9]{4}):([0-9]{2}):([0-9]{2}):([0-9]{2}) ?([+-][0-9]{4})?$", (3, 2, 1, 4, 5, 6, 0, 7)),
    (r"^(?:[A-Z][a-z]{2}, )?([0-9]{1,2}) ([A-Z][a-z]{2}) ([0-9]{4}) ([0-9]{2}):([0-9]{2}):([0-9]{2}) ?([+-][0-9]{4})?$", (3, 2, 1, 4, 5, 6, 0, 7)),
    (r"^([0-9]{2})[.]([0-9]{2})[.]([0-9]{4}) ([0-9]{2}):([0-9]{2}):([0-9]{2})$", (3, 2, 1, 4, 5, 6, 0, 0)),
    (r"^([0-9]{2})/([0-9]{2})/([0-9]{4}),? ([0-9]{1,2}):([0-9]{2}):([0-9]{2}) ([AP]M)$", (3, 1, 2, 4, 5, 6, 0, 7)),
    (r"^([A-Z][a-z]{2}) +([0-9]{1,2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})$", (0, 1, 2, 3, 4, 5, 0, 0)),
]


def _instants_sql() -> str:
    def place(i: int) -> str:
        cases = [f"WHEN regexp_matches(x, '{p}') THEN {f'regexp_extract(x, {chr(39)}{p}{chr(39)}, {g[i]})' if g[i] else chr(39) * 2}" for p, g in _SHAPES]
        return f"CASE {' '.join(cases)} END"

    names = "y mo d h mi s f z".split()
    return rf"""WITH t AS (SELECT id, log_source_id, epoch_us(received_at) AS got, regexp_replace(logged_at, '^[\s''"`(\[{{<]+|[\s''"`)\]}}>]+$', '', 'g') x FROM raw_entries),
 zs AS (SELECT log_source_id, min(zone_name) zone FROM source_zones GROUP BY ALL),
 p AS (SELECT t.id, got, x, coalesce(zone, 'UTC') zone, {', '.join(f'{place(i)} {n}' for i, n in enumerate(names))} FROM t LEFT JOIN zs USING (log_source_id)),
 n AS (SELECT *, coalesce(try_cast(mo AS INT), (instr('JanFebMarAprMayJunJulAugSepOctNovDec', mo) + 2) // 3) AS m,
  CASE WHEN z IN ('AM', 'PM') THEN try_cast(h AS INT) % 12 + CASE WHEN z = 'PM' THEN 12 ELSE 0 END ELSE try_cast(h AS INT) END AS hh FROM p),
 w AS (SELECT n.*, yy, try_cast(yy || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d, 2, '0') || ' ' || lpad(hh::VARCHAR, 2, '0') || ':' || mi || ':' || CASE WHEN s = '' THEN '00' ELSE s END AS TIMESTAMP) AS l
  FROM n, LATERAL (SELECT unnest(CASE WHEN n.y = '' THEN [2024, 2025, 2026, 2027] ELSE [try_cast(n.y AS INT)] END) AS yy) WHERE n.y IS NOT NULL),
 u AS (SELECT *, epoch_us(timezone(zone, l)) a, epoch_us(timezone(zone, l - INTERVAL 1 HOUR)) + 3600000000 b FROM w WHERE l IS NOT NULL),
 i AS (SELECT id, got, y, CASE WHEN z IN ('', 'AM', 'PM') THEN least(a, b) WHEN z IN ('Z', 'UTC', 'GMT') THEN epoch_us(l)
   WHEN regexp_matches(z, '^[+-]') THEN epoch_us(l) - CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (substr(z, 2, 2)::BIGINT * 60 + right(z, 2)::BIGINT) * 60000000
   WHEN regexp_matches(z, 'D|^(BST|CEST|EEST|WEST)$') THEN least(a, b) ELSE a END
  + coalesce(try_cast(rpad(substr(f, 1, 6), 6, '0') AS BIGINT), 0) AS us FROM u),
 r AS (SELECT id, arg_min(us, abs(us - got)) AS utc_us FROM i GROUP BY id),
 e AS (SELECT id, try_cast(regexp_extract(x, '^([0-9]+)', 1) AS HUGEINT) AS entry_timestamp, rpad(substr(regexp_extract(x, '[.]([0-9]+)$', 1), 1, 6), 6, '0') f
  FROM t WHERE regexp_full_match(x, '[0-9]{{9,19}}([.][0-9]+)?'))
 SELECT 'raw_entries' AS table_name, id, utc_us::BIGINT AS utc_us FROM r
 UNION ALL SELECT 'raw_entries', id, ({_EPOCH} + CASE WHEN entry_timestamp < 4102444800 THEN f::BIGINT ELSE 0 END)::BIGINT FROM e WHERE entry_timestamp >= 946684800
 UNION ALL SELECT 'occurrences', id, {_EPOCH} FROM occurrences WHERE entry_timestamp >= 946684800000"""


SQL = {
    "p5_found": _entries_sql(),
    "p7_found": _instants_sql(),
    "p2_found": """SELECT pattern_id FROM occurrences WHERE pattern_id IS NOT NULL GROUP BY pattern_id
 HAVING count(*) >= 0.02 * (SELECT count(*) FROM occurrences)""",
    "p2_counts": f"""WITH o AS (SELECT id, pattern_id, {_EPOCH} AS t FROM occurrences),
 s AS (SELECT *, t - lag(t) OVER (PARTITION BY pattern_id ORDER BY id) AS step FROM o WHERE t IS NOT NULL),
 a AS (SELECT pattern_id, count(*) AS n_rows FROM o GROUP BY pattern_id),
 b AS (SELECT pattern_id, count(*) AS n_timed, arg_min(t, id) AS first_us, arg_max(t, id) AS last_us,
   count(*) FILTER (WHERE step < 0) AS steps_back, max(step) AS longest_step_us FROM s GROUP BY pattern_id)
 SELECT a.pattern_id, n_rows, coalesce(n_timed, 0) AS n_timed, first_us, last_us, coalesce(steps_back, 0) AS steps_back,
   longest_step_us, n_rows - coalesce(p.occurrence_count, 0) AS count_delta
 FROM a LEFT JOIN b ON a.pattern_id IS NOT DISTINCT FROM b.pattern_id LEFT JOIN patterns p ON p.id = a.pattern_id""",
    "p3_found": """WITH c AS (SELECT log_source_id, arg_max(file_size, (scanned_at, scan_id)) AS size,
   max((scanned_at, scan_id)) AS k FROM source_scans WHERE status = 'complete' GROUP BY log_source_id),
 n AS (SELECT c.log_source_id, s.file_size, nullif(lower(regexp_replace(trim(s.file_hash), '^.*:\\s*', '')), '') AS h
   FROM c JOIN source_scans s ON s.log_source_id = c.log_source_id AND s.status = 'complete' AND (s.scanned_at, s.scan_id) = c.k),
 l AS (SELECT id, coalesce(last_processed_position, 0) AS pos,
   nullif(lower(regexp_replace(trim(file_hash), '^.*:\\s*', '')), '') AS h FROM log_sources),
 f AS (SELECT n.log_source_id, CASE WHEN coalesce(n.file_size < l.pos, false) OR coalesce(n.h <> l.h, false) THEN -1
   ELSE coalesce(l.pos, 0) END AS start FROM n LEFT JOIN l ON l.id = n.log_source_id)
 SELECT DISTINCT r.log_source_id, r.byte_offset FROM raw_entries r JOIN f USING (log_source_id)
 WHERE r.byte_offset IS NOT NULL AND (f.start = -1 OR r.byte_offset >= f.start)""",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_found, p5_found, p5_entries, p7_found, p7_readings)}
