"""Per-key results over keys of very uneven size.

Method: exact offset chunking. The input is cut into ranges of the order column, keys are counted per range, prefix sums
of those counts give each (range, key) its first row number, rows are numbered from there, and every key falls into
chunks of equal size which are processed apart; the ordered states at the chunk borders are merged per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a chunk at least, and chunks of the whole input about.
MIN_CHUNK, MOST_CHUNKS = 100_000, 8_192


#: Rows that one range of the order column holds about, and ranges at least and at most.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1_000_000, 64, 4_096
#: Bounds that one tree of comparisons takes; more of them are looked up in two steps.
_TREE = 64


def _bucket(col: Column, bounds: list[float], low: int = 0) -> Column:
    """Index of the range of ``col`` as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(col < F.lit(bounds[mid]), _bucket(col, bounds[:mid], low)).otherwise(
        _bucket(col, bounds[mid + 1 :], low + mid + 1)
    )


def _place(col: Column, bounds: list[float]) -> Column:
    """Index of the range of ``col``: the number of bounds that it reaches."""
    if len(bounds) <= _TREE:
        return _bucket(col, bounds)
    # a tree finds the stretch of bounds, and of those the reached ones are counted
    each = -(-len(bounds) // _TREE)
    stretches = F.array(*(F.array(*map(F.lit, bounds[i : i + each])) for i in range(0, len(bounds), each)))
    stretch = _bucket(col, bounds[each::each])
    return stretch * each + F.size(F.filter(F.get(stretches, stretch), lambda x: x <= col))


def number_by_key(df: DataFrame, key: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_no``, the row's exact number (from 0) within its key by ``order``, and ``_n``, the key's rows.

    ``order[0]`` must be numeric; the ranges are its approximate quantiles, of which ``ranges`` - 1 numbers reach the
    driver: by default as many as make ranges of ``RANGE_ROWS`` rows, between 64 and 4,096. No task holds more of a key than
    its part of one range. Null keys are numbered like any other key; null order values come first, in a range of their
    own; rows tied on all of ``order`` get distinct numbers in no particular order.
    """
    if ranges is None:
        ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-df.count() // RANGE_ROWS)))
    cuts = df.select(F.col(order[0]).cast("double").alias("o")).stat.approxQuantile(
        "o", [i / ranges for i in range(1, ranges)], 0.25 / ranges
    )
    first = F.col(order[0]).cast("double")
    placed = df.withColumn("_range", F.when(first.isNull(), -1).otherwise(_place(first, sorted(set(cuts)))))
    counted = placed.groupBy("_range", F.col(key).alias("_key")).agg(F.count("*").alias("_c"))
    by_key = W.partitionBy("_key")
    offsets = counted.select(
        F.col("_range").alias("_r"),
        "_key",
        F.coalesce(
            F.sum("_c").over(by_key.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_first"),
        F.sum("_c").over(by_key).alias("_n"),
    )
    local = W.partitionBy("_range", key).orderBy(*order)
    return (
        placed.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")))
        .withColumn("_no", F.col("_first") + F.col("_local"))
        .drop("_range", "_r", "_key", "_local", "_first")
    )


def per_key_profile(
    df: DataFrame, key: str, order: list[str], time: Column, min_chunk: int = MIN_CHUNK, ranges: int | None = None
) -> DataFrame:
    """One row per key: rows, first, last, least and greatest time, steps back in time and the longest step ahead.

    Columns: ``key, n_rows, n_timed, first_us, last_us, min_us, max_us, steps_back, longest_step_us, n_chunks,
    largest_chunk, n_all`` (rows of all keys). Times are compared along ``order`` between successive rows that have one. A null key is a key of
    its own; a key without any time has null times and 0 steps; an empty input gives no rows. Other columns of ``df``
    are not read, whatever their names.
    """
    slim = df.select(F.col(key).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], time.alias("t"))
    total = slim.count()
    size = max(min_chunk, -(-total // MOST_CHUNKS))
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, -(-total // RANGE_ROWS)))
    chunk = number_by_key(slim, "k", [f"o{i}" for i in range(len(order))], ranges).withColumn(
        "chunk", F.floor(F.col("_no") / size)
    )
    step = F.col("t") - F.last("t", ignorenulls=True).over(
        W.partitionBy("k", "chunk").orderBy("_no").rowsBetween(W.unboundedPreceding, -1)
    )
    states = (
        chunk.withColumn("step", step)
        .groupBy("k", "chunk")
        .agg(
            F.count("*").alias("n"),
            F.count("t").alias("timed"),
            F.min_by("t", F.when(F.col("t").isNotNull(), F.col("_no"))).alias("head"),
            F.max_by("t", F.when(F.col("t").isNotNull(), F.col("_no"))).alias("tail"),
            F.min("t").alias("lo"),
            F.max("t").alias("hi"),
            F.count_if(F.col("step") < 0).alias("back"),
            F.max("step").alias("ahead"),
        )
    )
    seam = F.col("head") - F.last("tail", ignorenulls=True).over(
        W.partitionBy("k").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        states.withColumn("seam", seam)
        .groupBy("k")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum("timed").alias("n_timed"),
            F.min_by("head", F.when(F.col("timed") > 0, F.col("chunk"))).alias("first_us"),
            F.max_by("tail", F.when(F.col("timed") > 0, F.col("chunk"))).alias("last_us"),
            F.min("lo").alias("min_us"),
            F.max("hi").alias("max_us"),
            (F.sum("back") + F.count_if(F.col("seam") < 0)).alias("steps_back"),
            F.greatest(F.max("ahead"), F.max("seam"), F.lit(None).cast("bigint")).alias("longest_step_us"),
            F.count("*").alias("n_chunks"),
            F.max("n").alias("largest_chunk"),
        )
        .withColumn("n_all", F.lit(total))
        .withColumnRenamed("k", key)
    )


def against_stored(profile: DataFrame, stored: DataFrame, key: str, stored_key: str, stored_count: str) -> DataFrame:
    """``profile`` with ``share`` of all rows, ``stored_count`` and ``count_delta`` (rows less stored; null is 0)."""
    side = stored.select(F.col(stored_key).alias("_k"), F.col(stored_count).alias("stored_count"))
    return (
        profile.join(side, F.col(key) == F.col("_k"), "left")
        .withColumn("share", F.col("n_rows") / F.col("n_all"))
        .withColumn("count_delta", F.col("n_rows") - F.coalesce("stored_count", F.lit(0)))
        .drop("_k")
    )
