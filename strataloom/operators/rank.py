"""Ranked patterns and what is shown with them: counts, distributions, time buckets, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.instants import epoch_us
from strataloom.functions.tokens import base_name, reconstruct


def like_any(text: Column, terms: list[str]) -> Column:
    """Whether a text contains one of the terms, letter case aside; ``%`` and ``_`` in a term are wildcards."""
    out = F.lit(False)
    for term in terms:
        out = out | text.ilike("%" + term.replace("\\", "\\\\") + "%")
    return out


def ranked(
    patterns: DataFrame,
    groups: DataFrame,
    top: int | None = None,
    filters: list[str] | None = None,
    in_groups: list[str] | None = None,
) -> DataFrame:
    """``pattern_id, group, template, occurrence_count`` of patterns with occurrences, most frequent first, ties by id."""
    g = groups.select(F.col("id").alias("gid"), F.col("name").alias("group"))
    p = patterns.where("occurrence_count > 0")
    if filters:
        p = p.where(like_any(F.col("template"), filters))
    if in_groups:
        g = g.where(F.col("group").isin(in_groups))
    out = p.join(g, F.col("file_group_id") == F.col("gid")).select(
        F.col("id").alias("pattern_id"), "group", "template", "occurrence_count"
    )
    out = out.orderBy(F.desc("occurrence_count"), "pattern_id")
    return out if top is None else out.limit(top)


def summary(patterns: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: ``n_patterns, n_occurrences, n_sources``."""
    p = patterns.agg(F.count("*").alias("n_patterns"), F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("n_occurrences"))
    return p.select("n_patterns", "n_occurrences", sources.agg(F.count("*")).scalar().alias("n_sources"))


def by_group(groups: DataFrame, patterns: DataFrame, only_seen: bool) -> DataFrame:
    """``group, n_patterns, n_occurrences``, groups without patterns too; ``only_seen`` counts patterns above 0 only."""
    on = F.col("gid") == F.col("file_group_id")
    if only_seen:
        on = on & (F.col("occurrence_count") > 0)
    g = groups.select(F.col("id").alias("gid"), F.col("name").alias("group"))
    p = patterns.select(F.col("id").alias("pid"), "file_group_id", "occurrence_count")
    return g.join(p, on, "left").groupBy("group").agg(
        F.count("pid").alias("n_patterns"), F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("n_occurrences")
    )


def sources_per_group(sources: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select(F.col("id").alias("gid"), F.col("name").alias("group"))
    return sources.join(g, F.col("file_group_id") == F.col("gid")).groupBy("group").agg(F.count("*").alias("n_sources"))


def distribution(occurrences: DataFrame, sources: DataFrame) -> DataFrame:
    """``pattern_id, source, n``: occurrences by pattern and source, labelled by file name. Counted before the join."""
    counted = occurrences.groupBy("pattern_id", "log_source_id").agg(F.count("*").alias("n"))
    s = sources.select(F.col("id").alias("sid"), F.col("file_path"))
    return counted.join(s, F.col("log_source_id") == F.col("sid")).select(
        "pattern_id", F.col("log_source_id"), base_name(F.col("file_path")).alias("source"), "n"
    )


def seconds(stamp: Column) -> Column:
    """Seconds of a stored timestamp in whatever unit; null if it is no instant."""
    return F.call_function("div", epoch_us(stamp), F.lit(10**6))


def time_range(occurrences: DataFrame) -> DataFrame:
    s = seconds(F.col("entry_timestamp"))
    return occurrences.agg(F.min(s).alias("first_ts"), F.max(s).alias("last_ts"))


def time_series(occurrences: DataFrame, bucket: str = "auto") -> DataFrame:
    """``pattern_id, bucket, n``: by ``hour`` or ``day``; ``auto`` is hours if all times lie within 48 hours."""
    timed = occurrences.select("pattern_id", F.timestamp_seconds(seconds(F.col("entry_timestamp"))).alias("ts")).where("ts is not null")
    hour, day = F.date_format("ts", "yyyy-MM-dd HH:00"), F.date_format("ts", "yyyy-MM-dd")
    if bucket == "hour":
        label = hour
    elif bucket == "day":
        label = day
    else:
        short = time_range(occurrences).select((F.col("last_ts") - F.col("first_ts")) < 48 * 3600).scalar()
        label = F.when(short, hour).otherwise(day)
    return timed.groupBy("pattern_id", label.alias("bucket")).agg(F.count("*").alias("n"))


def samples(occurrences: DataFrame, patterns: DataFrame, sources: DataFrame, n: int = 5, full_path: bool = False) -> DataFrame:
    """``pattern_id, rank, text, source``: the first ``n`` occurrences with variables of each pattern, written out.

    The order is source, offset, id; a pattern without variables has none. ``source`` is the file's name or full path.
    """
    w = W.partitionBy("pattern_id").orderBy("log_source_id", "byte_offset", "id")
    first = (
        occurrences.where("variables is not null and variables <> ''")
        .select("id", "pattern_id", "log_source_id", "byte_offset", "variables")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
    )
    p = patterns.select(F.col("id").alias("pid"), "template")
    s = sources.select(F.col("id").alias("sid"), "file_path")
    return (
        first.join(p, F.col("pattern_id") == F.col("pid"))
        .join(s, F.col("log_source_id") == F.col("sid"))
        .select(
            "pattern_id",
            "rank",
            reconstruct(F.col("template"), F.split("variables", "\t")).alias("text"),
            (F.col("file_path") if full_path else base_name(F.col("file_path"))).alias("source"),
        )
    )


def report(
    patterns: DataFrame,
    groups: DataFrame,
    occurrences: DataFrame,
    sources: DataFrame,
    tags: DataFrame | None = None,
    top: int = 500,
    n_samples: int = 5,
    bucket: str = "auto",
    suppressed: DataFrame | None = None,
    full_path: bool = False,
) -> DataFrame:
    """The ranked patterns with ``samples``, ``trend``, ``distribution``, ``tags`` and ``suppressed`` in one plan.

    Only the occurrences of the ranked patterns are bucketed. ``trend`` is the time series, or the distribution if no
    occurrence has a time.
    """
    best = ranked(patterns, groups, top)
    keys = best.select(F.col("pattern_id").alias("k"))  # sent to all tasks where Spark finds it small
    wanted = occurrences.join(keys, F.col("pattern_id") == F.col("k"), "left_semi")
    series = time_series(wanted, bucket).groupBy(F.col("pattern_id").alias("tp")).agg(
        F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("series")
    )
    spread = distribution(wanted, sources).groupBy(F.col("pattern_id").alias("dp")).agg(
        F.array_sort(F.collect_list(F.struct("source", "log_source_id", "n"))).alias("distribution")
    )
    shown = samples(wanted, patterns, sources, n_samples, full_path).groupBy(F.col("pattern_id").alias("sp")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "text", "source"))).alias("samples")
    )
    out = (
        best.join(series, F.col("pattern_id") == F.col("tp"), "left")
        .join(spread, F.col("pattern_id") == F.col("dp"), "left")
        .join(shown, F.col("pattern_id") == F.col("sp"), "left")
    )
    if tags is not None:
        own = tags.groupBy(F.col("pattern_id").alias("gp")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
        out = out.join(own, F.col("pattern_id") == F.col("gp"), "left")
    else:
        out = out.withColumn("tags", F.array().cast("array<string>"))
    if suppressed is not None:
        gone = suppressed.select(F.col("pattern_id").alias("xp"), F.lit(True).alias("suppressed"))
        out = out.join(gone, F.col("pattern_id") == F.col("xp"), "left")
    else:
        out = out.withColumn("suppressed", F.lit(False))
    as_trend = F.transform("distribution", lambda x: F.struct(x["source"].alias("bucket"), x["n"].alias("n")))
    return out.select(
        "pattern_id", "group", "template", "occurrence_count", "samples",
        F.coalesce("series", as_trend).alias("trend"), "distribution", "tags",
        F.coalesce("suppressed", F.lit(False)).alias("suppressed"),
    ).orderBy(F.desc("occurrence_count"), "pattern_id")
