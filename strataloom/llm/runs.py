"""Runs of identical or nearly identical consecutive events, each as one event.

Method: every event class is a symbol, the symbols of an entity in order are a string, and a regular expression with a
backreference finds the spans of a repeated symbol. Patterns that may be alike share a symbol; where the likeness of two
neighbours isn't settled by that, it is checked exactly and splits the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.session import cut, ship, small

WILDCARD = "<*>"
_REPEATED = re.compile(r"(.)\1+", re.DOTALL)
#: First code point used for symbols, and the surrogates, which no string may hold.
_BASE, _SURROGATE, _SURROGATES, _CODES = 0x100, 0xD800, 0x800, 1_000_000

_RUNS = (
    "source bigint, seam boolean, at_start boolean, at_end boolean, first bigint, last bigint, n bigint, head_pattern bigint, head_symbol bigint, "
    "head_detail string, tail_pattern bigint, tail_symbol bigint, tail_detail string, t_min bigint, t_max bigint"
)
_KINDS = [
    pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(),
    pa.int64(), pa.string(), pa.int64(), pa.int64(),
]
_NO_TIME = -(2**63)
#: Rows whose symbols form one string.
_BLOCK = 500_000
_NAMES = [c.split()[0] for c in _RUNS.split(", ")]


def event_classes(patterns: DataFrame, key: str, group: str, template: str) -> DataFrame:
    """``key, symbol, detail`` per pattern.

    Patterns share a symbol (the least key of the class) if they are of one group, have equally many tokens and agree
    wherever no pattern of that group and length has a wildcard; alike patterns always do. ``detail`` holds the tokens
    at the other positions, separated by blanks, and is null where there is one pattern only. Patterns without template
    have a symbol of their own. Repeated keys count once (least template).
    """
    p = (
        patterns.where(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("bigint").alias("key"))
        .agg(F.min(F.struct(F.col(group).alias("group"), F.col(template).alias("template"))).alias("p"))
        .select("key", "p.*")
        .withColumn("tokens", F.filter(F.split("template", r"\s+"), lambda x: x != ""))
        .withColumn("size", F.size("tokens"))
    )
    wild = (
        p.where("group is not null and size > 0")
        .select("group", "size", F.posexplode("tokens").alias("at", "token"))
        .groupBy("group", "size", "at")
        .agg(F.max(F.col("token") == WILDCARD).alias("wild"))
        .where("wild")
        .groupBy(F.col("group").alias("g"), F.col("size").alias("s"))
        .agg(F.collect_list("at").alias("loose"))  # at most as many as a template has tokens
    )
    placed = p.join(wild, (F.col("group") == F.col("g")) & (F.col("size") == F.col("s")), "left").withColumn(
        "loose", F.coalesce("loose", F.array().cast("array<int>"))
    )
    keyed = placed.withColumn(
        "firm",
        F.when(
            F.col("group").isNull() | F.col("template").isNull(), F.concat(F.lit("\n"), F.col("key").cast("string"))
        ).otherwise(
            F.array_join(F.transform("tokens", lambda t, i: F.when(F.array_contains("loose", i), "").otherwise(t)), " ")
        ),
    ).withColumn(
        "open", F.array_join(F.filter("tokens", lambda t, i: F.array_contains(F.col("loose"), i)), " ")
    )
    shared = keyed.groupBy("group", "size", "firm").agg(F.min("key").alias("symbol"), F.count("*").alias("members"))
    same = (
        keyed["group"].eqNullSafe(shared["group"])
        & (keyed["size"] == shared["size"])
        & (keyed["firm"] == shared["firm"])
    )
    return keyed.join(shared, same).select("key", "symbol", F.when(F.col("members") > 1, F.col("open")).alias("detail"))


def alike(a: str | None, b: str | None) -> bool:
    """Whether the loose tokens of two patterns with one symbol agree wherever neither is a wildcard."""
    if a is None or b is None:
        return a is b
    x, y = a.split(" "), b.split(" ")
    return len(x) == len(y) and all(p == q or WILDCARD in (p, q) for p, q in zip(x, y, strict=True))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A partition's batches as tables of about ``_BLOCK`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= _BLOCK:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _find(least: int):
    """Spans of a sorted partition, block by block: those of ``least`` events and more, and those at the two ends of a
    block (seams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for table in _blocks(batches):
            yield from spans(table, last)
            last = tuple(table.column(i)[-1].as_py() for i in (0, 1))

    def spans(table: pa.Table, last: tuple | None) -> Iterator[pa.RecordBatch]:
        source, offset, pattern, symbol = (table.column(i).to_numpy() for i in range(4))
        time = pc.fill_null(table.column(5), _NO_TIME).to_numpy()
        detail = table.column(4)
        keep = np.ones(len(source), bool)
        keep[1:] = (source[1:] != source[:-1]) | (offset[1:] != offset[:-1])  # repeated rows count once
        if last is not None:
            keep[: np.argmax(np.append((source != last[0]) | (offset != last[1]), True))] = False
        at = np.flatnonzero(keep)
        if not len(at):
            return
        source, offset, pattern, symbol, time = (x[at] for x in (source, offset, pattern, symbol, time))
        codes = np.unique(symbol, return_inverse=True)[1] % _CODES + _BASE
        codes = np.where(codes >= _SURROGATE, codes + _SURROGATES, codes)
        text = codes.astype("<u4").tobytes().decode("utf-32-le")
        n = len(text)
        known: dict[tuple[int, int], bool] = {}

        def word(i: int) -> str | None:
            return detail[int(at[i])].as_py()

        def linked(i: int) -> bool:
            """Whether event i is alike to the one before it (of one source)."""
            if symbol[i] != symbol[i - 1]:
                return False
            pair = (int(pattern[i - 1]), int(pattern[i]))
            if pair not in known:
                known[pair] = pair[0] == pair[1] or alike(word(i - 1), word(i))
            return known[pair]

        changes = np.concatenate([[0], np.cumsum(pattern[1:] != pattern[:-1])])
        edges = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1], [True]]))
        out: list[tuple] = []

        def emit(a: int, b: int) -> None:
            valid = time[a:b][time[a:b] != _NO_TIME]
            out.append((
                int(source[a]), a == 0 or b == n, a == 0, b == n, int(offset[a]), int(offset[b - 1]), b - a,
                int(pattern[a]), int(symbol[a]), word(a), int(pattern[b - 1]), int(symbol[b - 1]), word(b - 1),
                int(valid.min()) if len(valid) else None, int(valid.max()) if len(valid) else None,
            ))

        first = next((i for i in range(1, int(edges[1])) if not linked(i)), int(edges[1]))
        emit(0, first)
        if first < n:
            emit(next((i for i in range(n - 1, int(edges[-2]), -1) if not linked(i)), int(edges[-2])), n)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for m in _REPEATED.finditer(text, lo, hi):
                a, b = m.span()
                if b - a < least:
                    continue
                cuts = [a, b]
                if changes[b - 1] != changes[a]:
                    cuts[1:1] = [i for i in range(a + 1, b) if pattern[i] != pattern[i - 1] and not linked(i)]
                for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                    if end - start >= least and start > 0 and end < n:
                        emit(start, end)
        for i in range(0, len(out), 50_000):
            part = out[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*part, strict=True), _KINDS, strict=True)], names=_NAMES
            )

    return run


def _alike(before: Column, now: Column) -> Column:
    pairs = F.zip_with(F.split(before["d"], " "), F.split(now["d"], " "), lambda x, y: (x == y) | (x == WILDCARD) | (y == WILDCARD))
    return (before["p"] == now["p"]) | (
        (before["s"] == now["s"])
        & F.coalesce(F.forall(F.transform(pairs, lambda x: F.coalesce(x, F.lit(False))), lambda x: x), F.lit(False))
    )


def repeated_runs(
    events: DataFrame, source: str, offset: str, pattern: str, row_id: str, time: Column, classes: DataFrame, least: int = 3
) -> DataFrame:
    """Maximal chains of at least ``least`` events of a source in offset order, each alike to the next.

    Columns: ``log_source_id, first_byte_offset, last_byte_offset, n_events, first_us, last_us, duration_us``. Of rows
    with one source and offset the one with the least id counts. Rows without source, offset or pattern are left out; a
    pattern unknown to ``classes`` is alike to itself only; times may be null. Sources of any size are spread over tasks
    by offset; the two runs at a task's ends meet again by source and are merged in order.
    """
    ship(events.sparkSession)
    slim = events.select(
        F.col(source).cast("bigint").alias("source"),
        F.col(offset).cast("bigint").alias("offset"),
        F.col(pattern).cast("bigint").alias("pattern"),
        F.col(row_id).alias("row_id"),
        time.cast("bigint").alias("time"),
    ).where("source is not null and offset is not null and pattern is not null")
    # sent to all tasks if small; else a plain table, against which AQE can split a pattern with many rows
    marked = slim.join(small(cut(classes)), F.col("pattern") == F.col("key"), "left").select(
        "source",
        "offset",
        "row_id",
        "pattern",
        F.coalesce("symbol", -1 - F.col("pattern")).alias("symbol"),
        "detail",
        "time",
    )
    spans = (
        marked.repartitionByRange("source", "offset")
        .sortWithinPartitions("source", "offset", "row_id")
        .select("source", "offset", "pattern", "symbol", "detail", "time")
        .mapInArrow(_find(least), _RUNS)
    )
    # whole runs stay apart; the seams, two per task, meet by source
    w = W.partitionBy("source", "seam", "place").orderBy("first")
    tail = F.lag(F.struct(F.col("tail_pattern").alias("p"), F.col("tail_symbol").alias("s"), F.col("tail_detail").alias("d"), F.col("at_end").alias("e"))).over(w)
    head = F.struct(F.col("head_pattern").alias("p"), F.col("head_symbol").alias("s"), F.col("head_detail").alias("d"))
    chained = (
        spans.withColumn("place", F.when(~F.col("seam"), F.col("first")))
        .withColumn("tail", tail)
        .withColumn("new", F.when(F.coalesce(F.col("at_start") & F.col("tail.e") & _alike(F.col("tail"), head), F.lit(False)), 0).otherwise(1))
        .withColumn("chain", F.sum("new").over(w))
    )
    return (
        chained.groupBy("source", "seam", "place", "chain")
        .agg(
            F.min("first").alias("first_byte_offset"),
            F.max("last").alias("last_byte_offset"),
            F.sum("n").alias("n_events"),
            F.min("t_min").alias("first_us"),
            F.max("t_max").alias("last_us"),
        )
        .where(F.col("n_events") >= least)
        .select(
            F.col("source").alias("log_source_id"),
            "first_byte_offset",
            "last_byte_offset",
            "n_events",
            "first_us",
            "last_us",
            (F.col("last_us") - F.col("first_us")).alias("duration_us"),
        )
    )
