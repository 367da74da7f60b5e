"""Anomalies, differences between snapshots, and the gate built on both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.tokens import percent_change


def anomalies(
    patterns: DataFrame,
    groups: DataFrame,
    occurrences: DataFrame,
    sources: DataFrame,
    top: int | None = 50,
    suppressed: DataFrame | None = None,
) -> DataFrame:
    """``pattern_id, group, template, occurrence_count, score, reasons``, highest score first, ties by id.

    A pattern scores 2 if its group has several sources and it occurs in one only (or none), and its z-score if the
    count exceeds the group's mean by more than 3 population standard deviations. Patterns of count 0 take part;
    suppressed ones don't. A null count is 0.
    """
    g = groups.select(F.col("id").alias("gid"), F.col("name").alias("group"))
    count = F.coalesce("occurrence_count", F.lit(0)).alias("occurrence_count")
    p = patterns.select(F.col("id").alias("pattern_id"), "file_group_id", "template", count)
    p = p.join(g, F.col("file_group_id") == F.col("gid"))
    if suppressed is not None:
        p = p.join(suppressed.select(F.col("pattern_id").alias("xp")), F.col("pattern_id") == F.col("xp"), "left_anti")
    files = sources.groupBy(F.col("file_group_id").alias("fg")).agg(F.count("*").alias("n_sources"))
    pairs = occurrences.select("pattern_id", "log_source_id").distinct()
    seen = pairs.groupBy(F.col("pattern_id").alias("op")).agg(F.count("*").alias("seen_in"))
    spread = p.groupBy(F.col("file_group_id").alias("sg")).agg(
        F.avg("occurrence_count").alias("mean"), F.stddev_pop("occurrence_count").alias("sigma")
    )
    c = F.col("occurrence_count")
    scored = (
        p.join(files, F.col("file_group_id") == F.col("fg"), "left")
        .join(seen, F.col("pattern_id") == F.col("op"), "left")
        .join(spread, F.col("file_group_id") == F.col("sg"))
        .withColumn("lonely", (F.coalesce("n_sources", F.lit(0)) > 1) & (F.coalesce("seen_in", F.lit(1)) == 1))
        .withColumn("z", F.when(F.col("sigma") > 0, (c - F.col("mean")) / F.col("sigma")))
        .withColumn("high", F.coalesce(F.col("z") > 3.0, F.lit(False)))
        .where("lonely or high")
        .select(
            "pattern_id",
            "group",
            "template",
            "occurrence_count",
            (F.when(F.col("lonely"), 2.0).otherwise(0.0) + F.when(F.col("high"), F.col("z")).otherwise(0.0)).alias("score"),
            F.array_compact(
                F.array(
                    F.when(F.col("lonely"), F.format_string("single-source (1/%d files)", F.col("n_sources"))),
                    F.when(F.col("high"), F.format_string("high-count outlier (z=%.1f)", F.col("z"))),
                )
            ).alias("reasons"),
        )
        .orderBy(F.desc("score"), "pattern_id")
    )
    return scored if top is None else scored.limit(top)


def snapshot(patterns: DataFrame, groups: DataFrame) -> DataFrame:
    """``group, template, occurrence_count``: what a baseline holds."""
    g = groups.select(F.col("id").alias("gid"), F.col("name").alias("group"))
    return patterns.join(g, F.col("file_group_id") == F.col("gid")).select("group", "template", "occurrence_count")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``kind, group, template, before_count, after_count, delta, percent`` between two snapshots.

    ``new``: counted after, not there before; ``resolved``: counted before, not there after; ``changed``: counted in
    both, by more than a factor of two. One full join on (group, template).
    """
    counted = F.coalesce("occurrence_count", F.lit(0))
    b = before.select(F.col("group").alias("bg"), F.col("template").alias("bt"), counted.alias("b"))
    a = after.select("group", "template", counted.alias("a"))
    both = a.join(b, (F.col("group") == F.col("bg")) & (F.col("template") == F.col("bt")), "full")
    kind = (
        F.when(F.col("bg").isNull() & (F.col("a") > 0), "new")
        .when(F.col("group").isNull() & (F.col("b") > 0), "resolved")
        .when(
            (F.col("a") > 0) & (F.col("b") > 0) & ((F.col("a") > 2 * F.col("b")) | (2 * F.col("a") < F.col("b"))), "changed"
        )
    )
    return (
        both.withColumn("kind", kind)
        .where("kind is not null")
        .select(
            "kind",
            F.coalesce("group", "bg").alias("group"),
            F.coalesce("template", "bt").alias("template"),
            F.coalesce("b", F.lit(0)).alias("before_count"),
            F.coalesce("a", F.lit(0)).alias("after_count"),
            (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta"),
            F.when(F.col("kind") == "changed", percent_change(F.col("b"), F.col("a"))).alias("percent"),
        )
    )


def in_order(differences: DataFrame) -> DataFrame:
    """New patterns by their count, then resolved ones by theirs, then changed ones by the size of the change."""
    place = F.when(F.col("kind") == "new", 0).when(F.col("kind") == "resolved", 1).otherwise(2)
    return differences.orderBy(place, F.desc(F.abs("delta")), "group", "template")


_GATE = "name string, threshold double, actual double, passed boolean"


def _limit(name: str, actual: DataFrame, most: float) -> DataFrame:
    passed = (F.col("actual") <= most).alias("passed")
    return actual.select(F.lit(name).alias("name"), F.lit(float(most)).alias("threshold"), "actual", passed)


def gate(
    scores: DataFrame,
    differences: DataFrame | None,
    templates: DataFrame,
    max_score: float | None = None,
    max_new: int | None = None,
    needles: tuple[str, ...] = (),
) -> DataFrame:
    """``name, threshold, actual, passed`` of each check asked for.

    The greatest anomaly score, the number of new patterns (passed with a note where there is no baseline), and the
    number of patterns whose template contains a needle, which must be none.
    """
    spark = scores.sparkSession
    out = []
    if max_score is not None:
        greatest = scores.agg(F.round(F.coalesce(F.max("score"), F.lit(0.0)), 6).alias("actual"))
        out.append(_limit("max anomaly score", greatest, max_score))
    if max_new is not None and differences is not None:
        new = differences.where("kind = 'new'").agg(F.count("*").cast("double").alias("actual"))
        out.append(_limit("max new patterns", new, max_new))
    elif max_new is not None:
        out.append(spark.createDataFrame([("max new patterns (skipped: no baseline)", float(max_new), 0.0, True)], _GATE))
    if needles:
        found = [F.count_if(F.contains("template", F.lit(x))).cast("double").alias(f"n{i}") for i, x in enumerate(needles)]
        each = [
            F.struct(F.lit(f"no pattern contains {x!r}").alias("name"), F.col(f"n{i}").alias("actual"))
            for i, x in enumerate(needles)
        ]
        counts = templates.agg(*found).select(F.explode(F.array(*each)).alias("r"))
        passed = (F.col("r.actual") == 0).alias("passed")
        out.append(counts.select("r.name", F.lit(0.0).alias("threshold"), "r.actual", passed))
    result = out[0] if out else spark.createDataFrame([], _GATE)
    for other in out[1:]:
        result = result.unionByName(other)
    return result
