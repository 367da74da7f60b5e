"""Log entries with fields out of rows of differing layout, some spread over several rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.grammar import NEEDED, Grammar, HeaderParser
from strataloom.session import cut, ship, small

_PIECES = (
    "source bigint, first bigint, last bigint, head boolean, seam boolean, n_rows bigint, "
    "ts string, level string, component string, message string, unparsed array<struct<start:int,end:int>>"
)


def _pieces(with_text: bool, needed: tuple[str, ...]):
    """Entries of one sorted partition. The first rows may continue an entry of the partition before, the last entry
    may go on in the next: these two are marked as seams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = HeaderParser(Grammar(needed=needed))
        names = ["source", "first", "last", "head", "seam", "n_rows", "ts", "level", "component", "message", "unparsed"]
        kinds = [pa.int64()] * 3 + [pa.bool_()] * 2 + [pa.int64()] + [pa.string()] * 4
        kinds.append(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        now: list | None = None
        lines: list[str] = []
        first_source = last = None

        def closed(seam: bool) -> tuple:
            now[4] = seam or (not now[3])
            if with_text:
                now[9] = "\n".join(lines)
            return tuple(now)

        for batch in batches:
            out: list[tuple] = []
            for source, offset, text in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if (source, offset) == last:  # a repeated row
                    continue
                if last is None:
                    first_source = source
                last = (source, offset)
                fields = parse(text)
                if fields is not None or now is None or now[0] != source:
                    if now is not None:
                        out.append(closed(False))
                        now = None
                    if fields is not None:
                        spans = [{"start": a, "end": b} for a, b in fields["unparsed"]]
                        now = [source, offset, offset, True, False, 1, fields["ts"], fields["level"], fields["component"], None, spans]
                        lines = [fields["message"]]
                    elif source == first_source:
                        spans = [{"start": 0, "end": len(text or "")}]
                        now = [source, offset, offset, False, True, 1, None, None, None, None, spans]
                        lines = [text or ""]
                    # rows before the first header of a source that begins here belong to none
                else:
                    now[2] = offset
                    now[5] += 1
                    if with_text:
                        lines.append(text or "")
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema
                )
        if now is not None:
            rows = [closed(True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema
            )

    return run


def parse_entries(
    raw: DataFrame, source: str, offset: str, text: str, row_id: str, with_text: bool = True, needed: tuple[str, ...] = NEEDED
) -> DataFrame:
    """One row per log entry: ``log_source_id, byte_offset, last_byte_offset, n_rows, ts, log_level, component`` and,
    with ``with_text``, ``message``; ``unparsed`` holds the spans that no grammar rule covers.

    Rows are taken in order of (source, offset), of repeated ones that with a text and the least id. A row without a
    header continues the entry before it, also a null or empty one; rows before a source's first header belong to no
    entry; rows without source or offset are left out. Sources of any size are spread over tasks by offset; only the
    first rows and the last entry of a task meet again to be joined. Columns of other names are not read. ``needed`` are
    the fields a header must have: without ``co``, lines of programs that name no component are headers too.
    """
    ship(raw.sparkSession)
    slim = (
        raw.select(
            F.col(source).cast("bigint").alias("source"),
            F.col(offset).cast("bigint").alias("offset"),
            F.col(text).alias("text"),
            F.col(row_id).alias("row_id"),
        )
        .where("source is not null and offset is not null")
        .repartitionByRange("source", "offset")
        .sortWithinPartitions("source", "offset", F.col("text").isNull(), "row_id")
    )
    pieces = slim.select("source", "offset", "text").mapInArrow(_pieces(with_text, needed), _PIECES)
    # whole entries stay apart; the seams, two per task, meet by source
    place = F.when(~F.col("seam"), F.col("first"))
    w = W.partitionBy("source", "seam", "place").orderBy("first")
    numbered = pieces.withColumn("place", place).withColumn("entry", F.sum(F.col("head").cast("int")).over(w))
    in_order = F.array_sort(F.collect_list(F.struct("first", "message")))
    text_of = [F.array_join(F.transform(in_order, lambda x: x["message"]), "\n").alias("message")] if with_text else []
    return (
        numbered.where("entry > 0")
        .groupBy("source", "seam", "place", "entry")
        .agg(
            F.min("first").alias("byte_offset"),
            F.max("last").alias("last_byte_offset"),
            F.sum("n_rows").alias("n_rows"),
            *(F.max_by(c, "head").alias(c) for c in ("ts", "level", "component", "unparsed")),
            *text_of,
        )
        .select(
            F.col("source").alias("log_source_id"),
            "byte_offset",
            "last_byte_offset",
            "n_rows",
            "ts",
            F.col("level").alias("log_level"),
            "component",
            "unparsed",
            *(["message"] if with_text else []),
        )
    )


def variable_parts(message):
    """Tokens of a message that look like values (with digits, a path or a lone sign), in the order of the text."""
    return F.regexp_extract_all(message, F.lit(r"[^\s()\[\]{},;'\"<>]*(?:\d|/)[^\s()\[\]{},;'\"<>]*"), F.lit(0))


WILDCARD = "<*>"


def _tokens(text):
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _firm(tokens, loose):
    return F.array_join(F.transform(tokens, lambda t, i: F.when(F.array_contains(loose, i), "").otherwise(t)), " ")


def match_patterns(found: DataFrame, patterns: DataFrame, log_sources: DataFrame) -> DataFrame:
    """``found`` (entries with ``message``) with ``pattern_id`` and ``variables`` (TAB-joined), as occurrences have them.

    A message fits a template of its source's file group if it reads the same with every ``<*>`` replaced by some text
    without blanks. Of several that fit, the one with the fewest wildcards counts, then the least id. Where none fits,
    ``pattern_id`` is null and ``variables`` holds the parts that look like values. Messages and templates meet by group,
    number of tokens and the tokens at those positions where no template of that group and number has a wildcard.
    """
    t = (
        patterns.where("id is not null and file_group_id is not null and template is not null")
        .select(F.col("id").alias("t_id"), F.col("file_group_id").alias("t_group"), F.trim("template").alias("template"))
        .withColumn("t_tokens", _tokens(F.col("template")))
        .withColumn("t_size", F.size("t_tokens"))
    )
    blocks = (
        t.select("t_group", "t_size", F.posexplode("t_tokens").alias("at", "token"))
        .groupBy("t_group", "t_size", "at")
        .agg(F.max(F.contains("token", F.lit(WILDCARD))).alias("loose"))
        .groupBy(F.col("t_group").alias("b_group"), F.col("t_size").alias("b_size"))
        .agg(F.collect_list(F.when(F.col("loose"), F.col("at"))).alias("loose"))  # at most a template's tokens
    )
    blocks = small(cut(blocks))
    holes = F.size(F.split("template", r"<\*>")) - 1
    quoted = F.concat(F.lit(r"^\s*\Q"), F.replace("template", F.lit(WILDCARD), F.lit("\\E(\\S*?)\\Q")), F.lit("\\E\\s*$"))
    dollars = F.transform(
        F.sequence(F.lit(1), F.greatest(holes, F.lit(1))), lambda i: F.concat(F.lit("$"), i.cast("string"))
    )
    keyed = cut(
        t.join(blocks, (F.col("t_group") == F.col("b_group")) & (F.col("t_size") == F.col("b_size"))).select(
            "t_id", "t_group", "t_size", _firm(F.col("t_tokens"), F.col("loose")).alias("t_key"), holes.alias("holes"), quoted.alias("regex"),
            F.when(holes > 0, F.array_join(dollars, "\t")).otherwise("").alias("parts"),
        )
    )
    group_of = log_sources.select(F.col("id").alias("s_id"), F.col("file_group_id").alias("s_group"))
    text = F.regexp_replace("message", "\r\n", "\n")
    e = (
        found.withColumn("_m", text)
        .join(group_of, F.col("log_source_id") == F.col("s_id"), "left")
        .withColumn("_k", _tokens(F.col("_m")))
        .join(blocks, (F.col("s_group") == F.col("b_group")) & (F.size("_k") == F.col("b_size")), "left")
        .withColumn("_key", _firm(F.col("_k"), F.coalesce("loose", F.array().cast("array<int>"))))
    )
    fits = (F.col("s_group") == F.col("t_group")) & (F.size("_k") == F.col("t_size")) & (F.col("_key") == F.col("t_key"))
    near = e.join(keyed, fits, "left")
    hit = F.rlike("_m", F.col("regex"))
    carried = [c for c in found.columns if c not in ("log_source_id", "byte_offset")]
    best = near.groupBy("log_source_id", "byte_offset").agg(
        F.min(F.when(hit, F.struct("holes", "t_id", "regex", "parts"))).alias("best"),
        F.first("_m").alias("_m"),
        *(F.first(c).alias(c) for c in carried),
    )
    return best.select(
        *found.columns,
        F.col("best.t_id").alias("pattern_id"),
        F.when(F.col("best").isNull(), F.array_join(variable_parts(F.col("_m")), "\t"))
        .when(F.col("best.parts") == "", "")
        .otherwise(F.regexp_replace(F.col("_m"), F.col("best.regex"), F.col("best.parts")))
        .alias("variables"),
    )
