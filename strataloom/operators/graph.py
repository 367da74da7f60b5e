"""Connected components by min-labels and doubling, as joins over checkpointed tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import cut, ship


def forest(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``a, b``: edges with the same components as ``edges``, fewer than its nodes from each partition (union-find)."""
    ship(edges.sparkSession)

    def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            kept = []
            for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    kept.append((x, y))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], ["a", "b"])

    ends = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    return ends.where("a is not null and b is not null").mapInArrow(spanning, "a bigint, b bigint")


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every node; the component is its least node. Nodes without edges are their own.

    Every round each label takes the least among its own and its neighbours', then the label of its label. Edges with a
    null end are ignored. Labels are numbers; nothing is collected.
    """
    links = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = cut(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(nodes.select(F.col(node).alias("id")).where("id is not null").distinct().withColumn("label", F.col("id")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("n"), F.col("label").alias("l")), F.col("y") == F.col("n"))
            .groupBy("x")
            .agg(F.min("l").alias("least"))
        )
        lowered = labels.join(near, F.col("id") == F.col("x"), "left").select(
            "id", F.col("label").alias("old"), F.least("label", F.coalesce("least", "label")).alias("label")
        )
        lowered = cut(lowered)
        up = lowered.select(F.col("id").alias("n"), F.col("label").alias("l"))
        jumped = cut(
            lowered.join(up, F.col("label") == F.col("n"), "left").select(
                "id", "old", F.least("label", F.coalesce("l", "label")).alias("label")
            )
        )
        labels = jumped.select("id", "label")
        if jumped.where("label <> old").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
