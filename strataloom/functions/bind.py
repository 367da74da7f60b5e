"""Computed columns that are evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns that later expressions share. The optimizer copies plain ones into each of their uses, and
    filters on them below the projection; a generator it leaves alone."""
    bound = df.select("*", F.explode(F.array(F.struct(*(v.alias(k) for k, v in values.items())))).alias("_bound"))
    return bound.select("*", "_bound.*").drop("_bound")
