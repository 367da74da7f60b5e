"""How characteristic a term is of a record within its collection.

Method: probabilistic relevance weighting (BM25) with saturating term frequency and length normalisation. At the limits
``k1`` = infinity and ``b`` = 0 the frequency part becomes the plain number of uses; ``idf`` chooses the weight of rarity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.session import cut


def words(text: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def term_scores(
    records: DataFrame, key: str, group: str, text: str, k1: float = 1.2, b: float = 0.75, idf: str = "probabilistic"
) -> DataFrame:
    """``key, group, term, uses, n_records, n_with_term, score``, one row per record and term.

    ``idf``: ``probabilistic`` is ln(1 + (N - n + 0.5) / (n + 0.5)), ``plain`` ln(N / n), over the N records of the group.
    A null group is a group of its own; records with null or empty text count in N and have no terms; rows with a null
    or repeated key count as records like any other, a repeated key's terms being added up.
    """
    slim = records.select(F.col(key).alias("key"), F.col(group).alias("group"), words(F.col(text)).alias("w"))
    size = slim.groupBy("group").agg(
        F.count("*").alias("n_records"), F.avg(F.greatest(F.size("w"), F.lit(0))).alias("mean_length")
    )
    uses = cut(
        slim.select("key", "group", F.size("w").alias("length"), F.explode("w").alias("term"))
        .groupBy("key", "group", "term")
        .agg(F.count("*").alias("uses"), F.max("length").alias("length"))
    )
    # plain tables on both sides of the join below, so that AQE can split a term that most records of a group hold
    spread = cut(uses.groupBy(F.col("group").alias("g"), F.col("term").alias("t")).agg(F.count("*").alias("n_with_term")))
    n, df = F.col("n_records"), F.col("n_with_term")
    rarity = F.ln(n / df) if idf == "plain" else F.ln(1 + (n - df + 0.5) / (df + 0.5))
    if math.isinf(k1):
        frequency = F.col("uses").cast("double")
    else:
        norm = 1 - b + b * F.col("length") / F.col("mean_length")
        frequency = F.col("uses") * (k1 + 1) / (F.col("uses") + k1 * norm)
    sizes = size.withColumnRenamed("group", "sg")
    return (
        uses.join(spread, F.col("group").eqNullSafe(F.col("g")) & (F.col("term") == F.col("t")))
        .join(sizes, F.col("group").eqNullSafe(F.col("sg")))
        .select("key", "group", "term", "uses", "n_records", "n_with_term", F.round(frequency * rarity, 6).alias("score"))
    )


def most_characteristic(scores: DataFrame) -> DataFrame:
    """The rows of each key with its highest score, if above 0; ties all count."""
    best = F.max("score").over(W.partitionBy("key"))
    return scores.withColumn("best", best).where("score = best and score > 0").drop("best")
