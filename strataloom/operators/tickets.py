"""Patterns against external tickets: markers in descriptions, and what would have to be created or updated."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.operators.rank import seconds

@dataclass(frozen=True)
class Marker:
    """How a description names its pattern: the title of the fence around the line, and what the line begins with."""

    title: str = "pattern-marker"
    prefix: str = "pattern:"

    @property
    def fence(self) -> str:
        return "{code:title=" + self.title + "}"


def marker_line(db: Column, pattern_id: Column, count: Column, marker: Marker = Marker()) -> Column:
    return F.concat(
        F.lit(marker.prefix + "db="), db, F.lit(";pattern_id="), pattern_id.cast("string"), F.lit(";occurrences="), count.cast("string")
    )


def build_marker(db: Column, pattern_id: Column, count: Column, marker: Marker = Marker()) -> Column:
    return F.concat(F.lit(marker.fence + "\n"), marker_line(db, pattern_id, count, marker), F.lit("\n{code}"))


def parse_marker(description: Column, marker: Marker = Marker()) -> Column:
    """``struct<db, pattern_id, occurrences>`` of a description: three fields in the fence, or as the whole text; null
    if there is none or the first is empty. The prefix and the fields' names may be missing."""
    fields = rf"(?:\Q{marker.prefix}\E)?(?:db=)?([^;\n{{}}=]+);(?:pattern_id=)?\s*(-?\d+)\s*;(?:occurrences=)?\s*(\d+)\s*"
    fence = rf"(?s)\Q{marker.fence}\E\s*{fields}\{{code\}}"
    whole = rf"^\s*{fields}$"

    def part(i: int) -> Column:
        return F.when(description.rlike(fence), F.regexp_extract(description, fence, i)).when(
            description.rlike(whole), F.regexp_extract(description, whole, i)
        )

    return F.when(
        F.trim(part(1)) != "",
        F.struct(
            F.trim(part(1)).alias("db"), part(2).try_cast("bigint").alias("pattern_id"), part(3).try_cast("bigint").alias("occurrences")
        ),
    )


def document_text(node: Any, marker: Marker = Marker()) -> str:
    """Plain text of a description that is a JSON document of nested nodes; a string is itself. A code block in the
    marker's language gets the marker's fence."""
    if node is None or isinstance(node, str):
        return node or ""
    if isinstance(node, list):
        return "".join(document_text(n, marker) for n in node)
    text = node.get("text", "") + document_text(node.get("content", []), marker)
    if node.get("type") == "codeBlock" and (node.get("attrs") or {}).get("language") == marker.title:
        return f"{marker.fence}\n{text}\n{{code}}\n"
    return text + "\n" if node.get("type") in ("paragraph", "heading", "codeBlock") else text


def ticket_map(tickets: DataFrame, marker: Marker = Marker()) -> DataFrame:
    """``db, pattern_id, key, occurrences`` of tickets (``key, description``) with a marker; of several the least key."""
    m = tickets.select("key", parse_marker(F.col("description"), marker).alias("m")).where("m is not null")
    return m.groupBy("m.db", "m.pattern_id").agg(
        F.min(F.struct("key", F.col("m.occurrences").alias("occurrences"))).alias("t")
    ).select("db", "pattern_id", "t.key", "t.occurrences")


def plan(patterns: DataFrame, tickets: DataFrame, db: str, create: bool = True, marker: Marker = Marker()) -> DataFrame:
    """``pattern_id, occurrence_count, key, noted, action``: unchanged where the ticket has the count, update where it
    has another (``noted``), create where there is no ticket."""
    known = ticket_map(tickets, marker).where(F.col("db") == db).select(F.col("pattern_id").alias("tp"), "key", "occurrences")
    out = patterns.join(known, F.col("id") == F.col("tp"), "left").select(
        F.col("id").alias("pattern_id"),
        "occurrence_count",
        "key",
        F.col("occurrences").alias("noted"),
        F.when(F.col("key").isNull(), "create").when(F.col("occurrences") == F.col("occurrence_count"), "unchanged").otherwise("update").alias("action"),
    )
    return out if create else out.where("action <> 'create'")


def status(patterns: DataFrame, tickets: DataFrame, db: str, marker: Marker = Marker()) -> DataFrame:
    """One row: patterns with occurrences, tickets, patterns beyond the tickets, tickets with another count."""
    known = ticket_map(tickets, marker).where(F.col("db") == db).select(F.col("pattern_id").alias("tp"), "occurrences")
    total = patterns.where("occurrence_count > 0").agg(F.count("*").alias("total"))
    held = known.join(patterns.select("id", "occurrence_count"), F.col("tp") == F.col("id"), "left").agg(
        F.count("tp").alias("with_ticket"), F.count_if(F.col("occurrence_count") != F.col("occurrences")).alias("changed")
    )
    counted = held.select(total.scalar().alias("total"), "with_ticket", "changed")
    return counted.select(
        "total", "with_ticket", F.greatest(F.col("total") - F.col("with_ticket"), F.lit(0)).alias("new"), "changed"
    )


def summary_line(template: Column, prefix: str = "Log pattern: ", most: int = 255) -> Column:
    """One line of at most ``most`` bytes; where it is cut, three dots end it and no character is split."""
    line = F.concat(F.lit(prefix), F.regexp_replace(template, r"\s*\n\s*", " "))
    # a character takes 1 to 4 bytes: the longest beginning that fits, by its bytes
    fits = F.filter(F.sequence(F.lit(most - 3), F.lit((most - 3) // 4), F.lit(-1)), lambda n: F.octet_length(F.substring(line, F.lit(1), n)) <= most - 3)
    return F.when(F.octet_length(line) <= most, line).otherwise(F.concat(F.substring(line, F.lit(1), F.get(fits, F.lit(0))), F.lit("...")))


def facts(patterns: DataFrame, groups: DataFrame, occurrences: DataFrame, n_samples: int = 5) -> DataFrame:
    """``pattern_id, template, group, occurrence_count, first_seen, last_seen, samples`` of the given patterns.

    Times are texts, null without any. A sample is the values of an occurrence, between bars; the first ones by source,
    offset and id count, those without values don't.
    """
    g = groups.select(F.col("id").alias("gid"), F.col("name").alias("group"))
    p = patterns.join(g, F.col("file_group_id") == F.col("gid"), "left").select(
        F.col("id").alias("pattern_id"), "template", F.coalesce("group", F.lit("")).alias("group"), "occurrence_count"
    )
    o = occurrences.join(p.select(F.col("pattern_id").alias("k")), F.col("pattern_id") == F.col("k"), "left_semi")
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss 'UTC'")
    times = o.groupBy(F.col("pattern_id").alias("tp")).agg(
        F.min(seconds(F.col("entry_timestamp"))).alias("lo"), F.max(seconds(F.col("entry_timestamp"))).alias("hi")
    )
    order = W.partitionBy("pattern_id").orderBy("log_source_id", "byte_offset", "id")
    shown = (
        o.where("variables is not null and variables <> ''")
        .select("pattern_id", "variables", F.row_number().over(order).alias("no"))
        .where(F.col("no") <= n_samples)
        .groupBy(F.col("pattern_id").alias("sp"))
        .agg(F.array_sort(F.collect_list(F.struct("no", F.replace("variables", F.lit("\t"), F.lit(" | ")).alias("text")))).alias("s"))
    )
    return p.join(times, F.col("pattern_id") == F.col("tp"), "left").join(shown, F.col("pattern_id") == F.col("sp"), "left").select(
        "pattern_id", "template", "group", "occurrence_count", stamp(F.col("lo")).alias("first_seen"), stamp(F.col("hi")).alias("last_seen"),
        F.coalesce(F.transform("s", lambda x: x["text"]), F.array().cast("array<string>")).alias("samples"),
    )


def _node(kind: str, attrs: str | None, text: Column) -> Column:
    """A node of a document with one text, as JSON."""
    inner = F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))
    opening = f'{{"type":"{kind}",' + (f'"attrs":{attrs},' if attrs else "") + '"content":['
    return F.concat(F.lit(opening), inner, F.lit("]}"))


def _document(nodes: Column) -> Column:
    return F.concat(F.lit('{"version":1,"type":"doc","content":['), F.array_join(F.array_compact(nodes), ","), F.lit("]}"))


def body(rows: DataFrame, db: str, kind: str = "server", marker: Marker = Marker()) -> DataFrame:
    """``pattern_id, summary, description`` of patterns with ``template, group, occurrence_count, samples`` (texts) and,
    where there are such columns, ``first_seen, last_seen``. The description is wiki text for a ``server`` and a JSON
    document, as text, for ``cloud``."""
    count = F.format_number("occurrence_count", 0)
    none = F.lit(None).cast("string")
    first, last = (F.col(c) if c in rows.columns else none for c in ("first_seen", "last_seen"))
    listed = F.array_join("samples", "\n")
    some = F.size("samples") > 0
    if kind == "cloud":
        seen = F.concat_ws(
            " | ", F.concat(F.lit("Occurrences: "), count), F.concat(F.lit("First seen: "), first), F.concat(F.lit("Last seen: "), last),
            F.concat(F.lit("File group: "), F.col("group")),
        )
        text = _document(F.array(
            _node("heading", '{"level":3}', F.lit("Pattern")), _node("codeBlock", "{}", F.col("template")), _node("paragraph", None, seen),
            F.when(some, _node("heading", '{"level":3}', F.lit("Sample Log Lines"))), F.when(some, _node("codeBlock", "{}", listed)),
            _node("codeBlock", f'{{"language":"{marker.title}"}}', marker_line(F.lit(db), F.col("pattern_id"), F.col("occurrence_count"), marker)),
        ))
    else:
        block = lambda x: F.concat(F.lit("{noformat}\n"), x, F.lit("\n{noformat}"))
        seen = F.concat_ws(
            "\n", F.concat(F.lit("*Occurrences:* "), count), F.concat(F.lit("*First seen:* "), first), F.concat(F.lit("*Last seen:* "), last),
            F.concat(F.lit("*File group:* "), F.col("group")),
        )
        text = F.concat_ws(
            "\n\n",
            F.concat(F.lit("h3. Pattern\n"), block(F.col("template"))),
            seen,
            F.when(some, F.concat(F.lit("h3. Sample Log Lines\n"), block(listed))),
            build_marker(F.lit(db), F.col("pattern_id"), F.col("occurrence_count"), marker),
        )
    return rows.select("pattern_id", summary_line(F.col("template")).alias("summary"), text.alias("description"))


def change_comment(before: Column, after: Column, last_seen: Column, at: Column, kind: str = "server") -> Column:
    """What a ticket is told when its count has changed: wiki text or a JSON document, as text."""
    step = after - before
    count = F.concat(
        F.format_number(before, 0), F.lit(" -> "), F.format_number(after, 0), F.lit(" ("), F.when(step >= 0, "+").otherwise(""),
        F.format_number(step, 0), F.lit(")"),
    )
    seen = F.coalesce(last_seen, F.lit("unknown"))
    parts = [F.concat(F.lit("[pattern sync] Updated "), at), F.concat(F.lit("Occurrences: "), count), F.concat(F.lit("Last seen: "), seen)]
    if kind == "cloud":
        return _document(F.array(_node("paragraph", None, F.concat_ws(" | ", *parts))))
    return F.concat_ws("\n* ", *parts)
