"""Tags of patterns: reading, changing, filtering and suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tags that suppress a pattern.
SUPPRESSING = ("suppress", "ignore")


def tags_by_pattern(tags: DataFrame) -> DataFrame:
    return tags.groupBy("pattern_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def set_tags(tags: DataFrame, pattern_id: int, new: list[str]) -> DataFrame:
    """``tags`` with those of one pattern replaced."""
    spark = tags.sparkSession
    rows = spark.createDataFrame([(pattern_id, t) for t in dict.fromkeys(new)], "pattern_id bigint, tag string")
    return tags.where(F.col("pattern_id") != pattern_id).select("pattern_id", "tag").unionByName(rows)


def add_tag(tags: DataFrame, pattern_id: int, tag: str) -> DataFrame:
    row = tags.sparkSession.createDataFrame([(pattern_id, tag)], "pattern_id bigint, tag string")
    return tags.select("pattern_id", "tag").unionByName(row).distinct()


def remove_tag(tags: DataFrame, pattern_id: int, tag: str) -> DataFrame:
    return tags.where(~((F.col("pattern_id") == pattern_id) & (F.col("tag") == tag)))


def suppressed(tags: DataFrame) -> DataFrame:
    """``pattern_id`` of the patterns with a suppressing tag, spelled exactly so."""
    return tags.where(F.col("tag").isin(*SUPPRESSING)).select("pattern_id").distinct()


def read_tag_file(spark: SparkSession, path: str) -> DataFrame:
    """``pattern_id, tag`` out of a JSON object of lists. Malformed files, other keys and other values give nothing."""
    parsed = F.from_json("value", "map<string,array<string>>", {"mode": "PERMISSIVE"})
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(parsed).alias("key", "tags"))
        .select(F.col("key").try_cast("bigint").alias("pattern_id"), F.explode("tags").alias("tag"))
        .where("pattern_id is not null and tag is not null")
    )


def select_patterns(
    patterns: DataFrame,
    tags: DataFrame,
    anomalous: DataFrame | None = None,
    min_count: int | None = None,
    any_of: list[str] | None = None,
    none_of: list[str] | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Patterns that pass all conditions given: among ``anomalous``, frequent enough, with one of some tags, with none
    of others, and not among ``known`` (both by ``pattern_id``). Tags are compared as written."""
    out = patterns
    if min_count is not None:
        out = out.where(F.col("occurrence_count") >= min_count)
    for ids, how in ((anomalous, "left_semi"), (known, "left_anti")):
        if ids is not None:
            out = out.join(ids.select(F.col("pattern_id").alias("_k")), F.col("id") == F.col("_k"), how)
    for names, how in ((any_of, "left_semi"), (none_of, "left_anti")):
        if names:
            ids = tags.where(F.col("tag").isin(names)).select(F.col("pattern_id").alias("_k")).distinct()
            out = out.join(ids, F.col("id") == F.col("_k"), how)
    return out
