"""Log corpora rendered from the tables, and the model of patterns and occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.session import table


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``group, source, byte_offset, next_offset, line``: the events as lines of daily log files, one group per type."""
    e = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    level = F.when(F.col("event_type") == "error", "*ERROR*").otherwise("*INFO*")
    line = F.concat_ws(
        " ", stamp, level, "event_type", F.lit("user"), F.col("user_id").cast("string"), F.lit("value"),
        F.format_string("%.2f", "value"), F.lit("props"), "props",
    )
    return e.select(
        F.concat(F.col("event_type"), F.lit(".log")).alias("group"),
        F.concat(F.lit("/var/log/"), F.col("event_type"), F.lit(".log."), F.date_format("ts", "yyyy-MM-dd")).alias("source"),
        F.col("event_id").alias("byte_offset"),
        (F.col("event_id") + 1).alias("next_offset"),
        line.alias("line"),
    )


EVENT_LINES_SQL = """(SELECT event_type || '.log' AS "group",
 '/var/log/' || event_type || '.log.' || strftime(ts, '%Y-%m-%d') AS source, event_id AS byte_offset,
 strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN event_type = 'error' THEN '*ERROR*' ELSE '*INFO*' END || ' ' ||
 event_type || ' user ' || user_id || ' value ' || printf('%.2f', value) || ' props ' || props AS line FROM events)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents; each document is a source, its language the group."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select(
        F.coalesce("lang", F.lit("none")).alias("group"),
        F.col("doc_id").alias("source"),
        F.posexplode(F.split("text", "\n")).alias("byte_offset", "line"),
    ).select("group", "source", "byte_offset", (F.col("byte_offset") + 1).alias("next_offset"), F.regexp_replace("line", "\r$", "").alias("line"))


DOCUMENT_LINES_SQL = """(SELECT coalesce(lang, 'none') AS "group", doc_id AS source, i - 1 AS byte_offset,
 regexp_replace(p[i], '\\r$', '') AS line FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS p,
 unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"""


def evolving_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``group, source, byte_offset, next_offset, line, family``: the events as lines of 40 words, 14 of them the same in
    all; the other 26 are those of one of three families but for two, of which one varies with the user and one with the
    event."""
    e = table(spark, sf_dir, "events")
    family = F.pmod("user_id", F.lit(3))
    words = F.transform(
        F.sequence(F.lit(1), F.lit(26)),
        lambda i: F.when(i == 5, F.concat(F.lit("who-"), F.substring(F.lit("xyzuvw"), F.pmod("user_id", F.lit(6)).cast("int") + 1, F.lit(1))))
        .when(i == 9, F.concat(F.lit("how-"), F.substring(F.lit("pqrst"), F.pmod("event_id", F.lit(5)).cast("int") + 1, F.lit(1))))
        .otherwise(F.concat(F.substring(F.lit("klm"), family.cast("int") + 1, F.lit(1)), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), i, F.lit(1)))),
    )
    head = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("INFO one two three four five six seven eight nine ten eleven"))
    return e.select(
        F.col("event_type").alias("group"), F.lit("/var/log/long.log").alias("source"), F.col("event_id").alias("byte_offset"),
        (F.col("event_id") + 1).alias("next_offset"), F.concat_ws(" ", head, F.array_join(words, " ")).alias("line"), family.alias("family"),
    )


EVOLVING_LINES_SQL = """(SELECT event_type AS "group", event_id AS byte_offset, user_id % 3 AS family,
 strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO one two three four five six seven eight nine ten eleven ' || array_to_string(list_transform(range(1, 27),
  lambda i: CASE WHEN i = 5 THEN 'who-' || substr('xyzuvw', user_id % 6 + 1, 1) WHEN i = 9 THEN 'how-' || substr('pqrst', event_id % 5 + 1, 1)
   ELSE substr('klm', user_id % 3 + 1, 1) || substr('abcdefghijklmnopqrstuvwxyz', i, 1) END), ' ') AS line FROM events)"""
