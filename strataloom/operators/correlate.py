"""Patterns that occur together in time, and patterns that share variable values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.operators.graph import components, forest
from strataloom.operators.rank import seconds
from strataloom.session import cut, small

#: Parts into which the patterns are divided for counting pairs, per core; every set of patterns is sent once to each part.
PARTS_PER_CORE = 4
#: Rows (pattern, second) of a bin that one task pairs with the bin's others.
BIN_ROWS = 5_000


def correlations(
    occurrences: DataFrame,
    patterns: DataFrame,
    window: int = 60,
    min_count: int = 10,
    top: int | None = 20,
    earliest: int | None = None,
    min_observed: int = 3,
    min_confidence: float = 1.5,
) -> DataFrame:
    """``a, b, observed, expected, confidence, median_lag`` of pattern pairs of different groups.

    Observed are pairs of occurrences at most ``window`` seconds apart; expected is c_a c_b window / span, one-sided as
    defined, so independent patterns score about 2. The lag is the upper median. Only patterns with a count of at least
    ``min_count`` and occurrences with a time take part; ``earliest`` (off by default) keeps so many by time.

    Occurrences are counted per pattern and second first; seconds are joined by bins of the window's width, so the join
    is an equi-join and its size is that of the pairs of (pattern, second). A bin is divided among tasks by the earlier
    pattern, in as many parts as its seconds ask for, and the later ones are sent to each of its parts.
    """
    p = patterns.where(F.col("occurrence_count") >= min_count).select(F.col("id").alias("pid"), F.col("file_group_id").alias("grp"))
    timed = (
        occurrences.select("id", "pattern_id", seconds(F.col("entry_timestamp")).alias("ts"))
        .where("ts is not null")
        .join(p, F.col("pattern_id") == F.col("pid"))
        .select("id", "pid", "grp", "ts")
    )
    counts = timed.groupBy("pid").agg(F.count("*").alias("c"))
    if earliest is not None:
        timed = timed.orderBy("ts", "id").limit(earliest)
    span = timed.agg(F.greatest(F.max("ts") - F.min("ts"), F.lit(1))).scalar()
    per_second = timed.groupBy("pid", "grp", "ts").agg(F.count("*").alias("n"))
    width = max(window, 1)
    bin_of = F.floor(F.col("ts") / width)
    binned = cut(per_second.withColumn("bin", bin_of))
    # parts of the bins whose pairs are too many for a task; all other bins are whole
    full = small(cut(binned.groupBy(F.col("bin").alias("fb")).agg(F.count("*").alias("m")).where(F.col("m") > BIN_ROWS).select("fb", F.ceil(F.col("m") / BIN_ROWS).cast("int").alias("parts"))))
    first = binned.join(full, F.col("bin") == F.col("fb"), "left").select(
        F.col("pid").alias("p1"), F.col("grp").alias("g1"), F.col("ts").alias("t1"), F.col("n").alias("n1"), "bin",
        F.pmod(F.xxhash64("pid"), F.coalesce("parts", F.lit(1))).alias("part"),
    )
    second = (
        binned.select(
            F.col("pid").alias("p2"), F.col("grp").alias("g2"), F.col("ts").alias("t2"), F.col("n").alias("n2"),
            F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin2"),
        )
        .join(full, F.col("bin2") == F.col("fb"), "left")
        .withColumn("part2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)).cast("bigint") - 1)))
    )
    later = (F.col("t2") > F.col("t1")) | ((F.col("t2") == F.col("t1")) & (F.col("p1") < F.col("p2")))
    lags = (
        first.join(
            second,
            (F.col("bin") == F.col("bin2")) & (F.col("part") == F.col("part2")) & (F.col("g1") != F.col("g2")) & later & (F.col("t2") - F.col("t1") <= window),
        )
        .groupBy(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b"), (F.col("t2") - F.col("t1")).alias("lag"))
        .agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))
    )
    pair = W.partitionBy("a", "b")
    upto = F.sum("n").over(pair.orderBy("lag").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(pair)
    # at most window + 1 lags per pair; the upper median is the least lag with more than half before or at it
    half = lags.withColumn("upto", upto).withColumn("observed", total)
    summed = half.groupBy("a", "b").agg(
        F.max("observed").alias("observed"),
        F.min(F.when(F.col("upto") > F.floor(F.col("observed") / 2), F.col("lag"))).alias("median_lag"),
    )
    ca = counts.select(F.col("pid").alias("ia"), F.col("c").alias("ca"))
    cb = counts.select(F.col("pid").alias("ib"), F.col("c").alias("cb"))
    ratio = F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")).otherwise(F.col("observed").cast("double"))
    out = (
        summed.join(ca, F.col("a") == F.col("ia"))
        .join(cb, F.col("b") == F.col("ib"))
        .withColumn("expected", F.col("ca") * F.col("cb") * float(window) / span)
        .withColumn("confidence", ratio)
        .where((F.col("observed") >= min_observed) & (F.col("confidence") >= min_confidence))
        .select("a", "b", "observed", "expected", "confidence", "median_lag")
        .orderBy(F.desc("confidence"), "a", "b")
    )
    return out if top is None else out.limit(top)


def preview(template, most: int = 80):
    """The beginning of a template on one line; three dots stand for what is cut."""
    line = F.regexp_replace(template, r"\s*\n\s*", " ")
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, most - 3), F.lit("...")))


def described(pairs: DataFrame, patterns: DataFrame, groups: DataFrame) -> DataFrame:
    """Correlated pairs (``a, b`` and more) with ``group_a, template_a, group_b, template_b``, in the same order."""
    g = groups.select(F.col("id").alias("gid"), F.col("name").alias("group"))
    p = patterns.join(g, F.col("file_group_id") == F.col("gid"), "left")
    out = pairs
    for side in ("a", "b"):
        names = p.select(F.col("id").alias("_i"), F.col("group").alias(f"group_{side}"), preview(F.col("template")).alias(f"template_{side}"))
        out = out.join(names, F.col(side) == F.col("_i"), "left").drop("_i")
    return out.orderBy(F.desc("confidence"), "a", "b")


def described_clusters(found: DataFrame, patterns: DataFrame, most: int = 10) -> DataFrame:
    """Clusters with ``templates``, the beginnings of the templates of their first ``most`` patterns."""
    p = patterns.select(F.col("id").alias("_i"), preview(F.col("template")).alias("_t"))
    shown = (
        found.select(F.col("cluster").alias("_c"), F.explode(F.slice("patterns", 1, most)).alias("_p"))
        .join(p, F.col("_p") == F.col("_i"))
        .groupBy("_c")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"]).alias("templates"))
    )
    return found.join(shown, F.col("cluster") == F.col("_c"), "left").drop("_c").orderBy(F.desc("n_patterns"), "cluster")


def variable_index(occurrences: DataFrame, patterns: DataFrame, top_patterns: int | None = None) -> DataFrame:
    """``pattern_id, value``: distinct variable values of the patterns, without noise (single bytes and numbers below
    1,000). ``top_patterns`` (off by default) keeps only so many by their stored count."""
    best = patterns.select(F.col("id").alias("k"), "occurrence_count").orderBy(F.desc("occurrence_count"), "k")
    if top_patterns is not None:
        best = best.limit(top_patterns)
    value = F.trim(F.col("value"))
    noise = (F.octet_length(value) < 5) & value.rlike("^[0-9]+$") & (F.coalesce(value.try_cast("int"), F.lit(0)) < 1000)
    return (
        occurrences.where("variables is not null and variables <> ''")
        .join(best.select("k"), F.col("pattern_id") == F.col("k"), "left_semi")
        .select("pattern_id", F.explode(F.split("variables", "\t")).alias("value"))
        .select("pattern_id", value.alias("value"))
        .where((F.octet_length("value") > 1) & ~noise)
        .distinct()
    )


def shared_values(index: DataFrame) -> DataFrame:
    """``value, who``: values that at least 2 and at most half of the patterns have, with those patterns."""
    most = index.agg(F.greatest(F.floor(F.count_distinct("pattern_id") / 2), F.lit(2))).scalar()
    return (
        index.groupBy("value")
        .agg(F.array_sort(F.collect_set("pattern_id")).alias("who"))  # a number per pattern at most
        .where((F.size("who") >= 2) & (F.size("who") <= most))
        .select("value", "who")
    )


def shared_value_pairs(values: DataFrame, min_shared: int = 3) -> DataFrame:
    """``a, b, shared``: pattern pairs with at least ``min_shared`` shared values in common.

    Values are first counted by the set of patterns they occur in; pairs come from the distinct sets, not the values. The
    patterns are divided into parts, and a part's task pairs its own members of every set with those after them. So a set
    of many patterns is split over all tasks, and pairs are counted where they arise and never shuffled.
    """
    sets = values.groupBy("who").agg(F.count("*").alias("n"))
    parts = PARTS_PER_CORE * values.sparkSession.sparkContext.defaultParallelism
    part_of = lambda p: F.pmod(F.xxhash64(p), F.lit(parts)).cast("int")
    return (
        sets.select("who", "n", F.explode(F.array_distinct(F.transform("who", part_of))).alias("part"))
        .repartition(parts, "part")
        .select("part", "who", "n", F.posexplode("who").alias("i", "a"))
        .where(part_of(F.col("a")) == F.col("part"))
        .select("part", "a", "n", F.explode(F.slice("who", F.col("i") + 2, F.size("who"))).alias("b"))
        .groupBy("part", "a", "b")
        .agg(F.sum("n").alias("shared"))
        .where(F.col("shared") >= min_shared)
        .select("a", "b", "shared")
    )


def clusters(
    occurrences: DataFrame,
    patterns: DataFrame,
    min_shared: int = 3,
    top: int | None = 20,
    top_patterns: int | None = None,
) -> DataFrame:
    """``cluster, n_patterns, patterns, values``: groups of patterns linked by shared values, largest first, with up to
    10 values (least first) that two members share."""
    shared = cut(shared_values(variable_index(occurrences, patterns, top_patterns)))
    pairs = cut(forest(shared_value_pairs(shared, min_shared)))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    member = components(ends, pairs)
    rank = W.partitionBy("component").orderBy("value")
    values = (
        shared.select("value", F.explode("who").alias("p"))
        .join(member, F.col("p") == F.col("id"))
        .groupBy("component", "value")
        .agg(F.count("*").alias("n"))
        .where("n >= 2")
        .withColumn("r", F.row_number().over(rank))
        .where("r <= 10")
        .groupBy(F.col("component").alias("vc"))
        .agg(F.array_sort(F.collect_list("value")).alias("values"))
    )
    out = (
        member.groupBy(F.col("component").alias("cluster"))
        .agg(F.count("*").alias("n_patterns"), F.array_sort(F.collect_list("id")).alias("patterns"))
        .join(values, F.col("cluster") == F.col("vc"), "left")
        .select("cluster", "n_patterns", "patterns", "values")
        .orderBy(F.desc("n_patterns"), "cluster")
    )
    return out if top is None else out.limit(top)
