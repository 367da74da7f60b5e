"""Lines into entries: which line shapes begin an entry, and what belongs to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.tokens import is_indented, line_fingerprint
from strataloom.session import ship

#: Share of a source's unindented lines that the shapes of entry starts cover.
COVERAGE = 0.9


def entry_fingerprints(lines: DataFrame, source: str, line: str) -> DataFrame:
    """``source, fingerprint, n``: the commonest line shapes of each source that together cover 90 % of its unindented
    lines. Ties are broken by the shape. Blank lines don't count; a source of blank lines only has no row."""
    counted = (
        lines.select(F.col(source).alias("source"), line_fingerprint(F.col(line)).alias("fingerprint"), is_indented(F.col(line)).alias("i"))
        .where("not i and fingerprint <> ''")
        .groupBy("source", "fingerprint")
        .agg(F.count("*").alias("n"))
    )
    ranked = W.partitionBy("source").orderBy(F.desc("n"), "fingerprint")
    before = F.coalesce(F.sum("n").over(ranked.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(W.partitionBy("source"))
    return (
        counted.withColumn("before", before)
        .withColumn("total", total)
        .withColumn("rank", F.row_number().over(ranked))
        .where((F.col("rank") == 1) | (F.col("before") < F.floor(F.col("total") * COVERAGE)))
        .select("source", "fingerprint", "n")
    )


def mark_starts(lines: DataFrame, source: str, line: str, prints: DataFrame) -> DataFrame:
    """``lines`` with ``is_start``: not indented and of a shape in ``prints``; every line where a source has none."""
    shape = line_fingerprint(F.col(line))
    known = prints.select(F.col("source").alias("_ps"), F.col("fingerprint").alias("_pf"), F.lit(True).alias("_hit"))
    some = prints.select(F.col("source").alias("_ss")).distinct().withColumn("_some", F.lit(True))
    return (
        lines.withColumn("_shape", shape)
        .join(known, F.col(source).eqNullSafe(F.col("_ps")) & (F.col("_shape") == F.col("_pf")), "left")
        .join(some, F.col(source).eqNullSafe(F.col("_ss")), "left")
        .withColumn(
            "is_start",
            F.col("_some").isNull() | (~is_indented(F.col(line)) & F.coalesce("_hit", F.lit(False))),
        )
        .drop("_shape", "_ps", "_pf", "_hit", "_ss", "_some")
    )


_ENTRY = "source string, byte_offset bigint, next_offset bigint, primary_line string, continuation array<string>, head boolean, seam boolean"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of one sorted partition; the rows before its first start and its last entry are marked as seams.

    Rows are never looked at one by one: an entry is a slice of the columns. The rows of the last entry wait for the next
    batch with a start.
    """
    waiting: list[pa.RecordBatch] = []
    opening = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if opening is None:
            opening = batch.column(0)[0].as_py()
        began = batch.column(0)[0].as_py()
        goes_on = waiting and waiting[-1].column(0)[-1].as_py() == began and pc.all(pc.equal(batch.column(0), began)).as_py()
        if goes_on and not pc.any(batch.column(4)).as_py():
            waiting.append(batch)
            continue
        rows = pa.Table.from_batches([*waiting, batch]).combine_chunks()
        edges = _edges(rows)
        yield from _entries(rows, edges[:-1], opening, False)
        waiting = rows.slice(edges[-2]).to_batches()
    if waiting:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        yield from _entries(rows, _edges(rows), opening, True)


def _edges(rows: pa.Table) -> np.ndarray:
    """First rows of the pieces, and the number of rows."""
    source = rows.column(0).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = rows.column(4).to_numpy().astype(bool)
    first[0] = True
    first[1:] |= source[1:] != source[:-1]
    return np.append(np.flatnonzero(first), len(source))


def _entries(rows: pa.Table, edges: np.ndarray, opening: str, last: bool) -> Iterator[pa.RecordBatch]:
    """The pieces between ``edges``; those without a start are dropped, but for that of the partition's first source."""
    lo, hi = edges[:-1], edges[1:]
    if not len(lo):
        return
    head = rows.column(4).to_numpy().astype(bool)[lo]
    kept = np.flatnonzero(head | np.asarray(pc.equal(rows.column(0).take(pa.array(lo)), opening)))
    seam = ~head
    seam[-1] |= last
    lo, hi, head, seam = lo[kept], hi[kept], head[kept], seam[kept]
    line = rows.column(3).combine_chunks()
    size = hi - lo - head
    more = np.repeat(lo + head - (np.cumsum(size) - size), size) + np.arange(size.sum())
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    yield pa.RecordBatch.from_arrays(
        [
            rows.column(0).combine_chunks().take(pa.array(lo)), rows.column(1).combine_chunks().take(pa.array(lo)),
            rows.column(2).combine_chunks().take(pa.array(hi - 1)), line.take(pa.array(lo, mask=~head)),
            pa.ListArray.from_arrays(offsets, line.take(pa.array(more))), pa.array(head), pa.array(seam),
        ],
        names=["source", "byte_offset", "next_offset", "primary_line", "continuation", "head", "seam"],
    )


def group_entries(lines: DataFrame, source: str, offset: str, after: str, line: str, start: str = "is_start") -> DataFrame:
    """One row per entry: ``source, byte_offset, next_offset, primary_line, continuation``.

    A line that is no start belongs to the entry before it; those before a source's first start are dropped. Rows are
    spread by range of (source, offset), so a source of any size takes many tasks; only the pieces at the ends of tasks
    meet again.
    """
    ship(lines.sparkSession)
    slim = lines.where(F.col(source).isNotNull() & F.col(offset).isNotNull()).select(
        F.col(source).cast("string").alias("source"),
        F.col(offset).cast("bigint").alias("at"),
        F.col(after).cast("bigint").alias("after"),
        F.coalesce(F.col(line), F.lit("")).alias("line"),
        F.col(start).alias("start"),
    )
    pieces = slim.repartitionByRange("source", "at").sortWithinPartitions("source", "at").mapInArrow(_fold, _ENTRY)
    place = F.when(~F.col("seam"), F.col("byte_offset"))
    w = W.partitionBy("source", "seam", "place").orderBy("byte_offset")
    return (
        pieces.withColumn("place", place)
        .withColumn("entry", F.sum(F.col("head").cast("int")).over(w))
        .where("entry > 0")
        .groupBy("source", "seam", "place", "entry")
        .agg(
            F.min("byte_offset").alias("byte_offset"),
            F.max("next_offset").alias("next_offset"),
            F.max("primary_line").alias("primary_line"),
            F.flatten(
                F.transform(F.array_sort(F.collect_list(F.struct("byte_offset", "continuation"))), lambda x: x["continuation"])
            ).alias("continuation"),
        )
        .select("source", "byte_offset", "next_offset", "primary_line", "continuation")
    )
