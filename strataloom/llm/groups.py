"""One group identifier for all records linked by pairwise matches, directly or through others.

Method: union-find within the partitions of the edges, of which only a spanning forest is kept; forests are merged in
fewer and fewer partitions, none of them beyond a bound, until one partition holds the last forest. Where the forest of
all components exceeds the bound, the merging goes on by key, over partitions within the bound, until every node has one
parent, and parents are then followed by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.session import cut

#: Edges of a forest that one task may hold, and partitions merged into one at each level.
EDGES_PER_TASK, FAN_IN = 2_000_000, 8

_SCHEMA = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's edges; every node but the least of its component, with that least node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                lo, hi = (ra, rb) if ra < rb else (rb, ra)
                parent[hi] = lo
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        roots = [find(x) for x in part]
        kept = [(x, r) for x, r in zip(part, roots, strict=True) if x != r]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], schema=_SCHEMA)


def _united(edges: DataFrame) -> DataFrame:
    return edges.select("node", "root").mapInArrow(_forest, "node bigint, root bigint")


def components(edges: DataFrame, a: str, b: str, most: int = EDGES_PER_TASK) -> DataFrame:
    """``node, root`` for every node that isn't the least of its component; ``root`` is the least.

    Loops, repeated edges and edges with a null end are ignored; no edges give no rows. ``most`` bounds the edges that
    one task holds.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    forest = cut(
        _united(edges.select(F.greatest(x, y).alias("node"), F.least(x, y).alias("root"), x.alias("x"), y.alias("y")).where("x <> y"))
    )
    parts = max(1, forest.rdd.getNumPartitions())
    while True:
        needed = max(1, -(-forest.count() // most))
        if parts == 1 and needed == 1:
            return forest
        if needed > 1 and parts <= FAN_IN * needed:
            return _beyond_one_task(forest, needed * 2)
        parts = max(-(-parts // FAN_IN), needed)
        forest = cut(_united(forest.repartition(parts, "node")))


def _beyond_one_task(forest: DataFrame, parts: int) -> DataFrame:
    while True:
        # edges go to the task of their greater end: all parents of a node meet there and are united
        forest = cut(_united(forest.repartition(parts, "node")).distinct())
        edges, nodes = forest.agg(F.count("*"), F.count_distinct("node")).first()
        if edges == nodes:
            break
    while True:
        up = forest.select(F.col("node").alias("n"), F.col("root").alias("r"))
        jumped = cut(
            forest.join(up, F.col("root") == F.col("n"), "left").select(
                "node", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")
            )
        )
        forest = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return forest


#: A dotted decimal address, with or without a port: two numbers side by side, whose digits are no one identifier.
_ADDRESS = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}([^\p{L}\p{N}]+[0-9]{1,5})?[^\p{L}\p{N}]*$"


def identifiers(variables: Column) -> Column:
    """Distinct identifiers among TAB-joined variables, as ``array<bigint>``.

    An identifier is a variable that, without letter case, punctuation, a label (lower-case letters before ``=`` or
    ``:``) and a leading ``0x``, is 16 hexadecimal digits, not all the same. Network addresses with their ports aren't
    identifiers, whatever the number of their digits. Null or empty variables give an empty array.
    """

    def one(v: Column) -> Column:
        bare = F.regexp_replace(v, r"^[^\p{L}\p{N}]*([a-z]+[=:])?[^\p{L}\p{N}]*", "")
        digits = F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]", ""), "^0x", "")
        found = F.when(digits.rlike(r"^(?!(.)\1{15}$)[0-9a-f]{16}$") & ~bare.rlike(_ADDRESS), digits)
        return F.conv(found, 16, -10).cast("bigint")

    long = F.filter(F.split(variables, "\t"), lambda v: F.length(v) >= 16)
    return F.when(
        F.regexp_replace(variables, r"[^0-9A-Za-z\t]", "").rlike("[0-9A-Fa-f]{16}"),
        F.array_distinct(F.array_compact(F.transform(long, one))),
    ).otherwise(F.array().cast("array<bigint>"))


def linked_by_identifiers(rows: DataFrame, row_id: str, kind: str, variables: str, most: int = EDGES_PER_TASK) -> DataFrame:
    """``id, group_id``: rows sharing an identifier that occurs with at least two different ``kind`` are linked.

    ``group_id`` is the least id among all rows linked directly or indirectly. Rows without identifier, and identifiers
    of one kind only, are left out; a null kind is no kind. Repeated rows have ids of their own and count each. The rows
    of an identifier are joined to the least of them, never paired with each other.
    """
    held = cut(
        rows.select(
            F.col(row_id).cast("bigint").alias("id"), F.col(kind).alias("kind"), identifiers(F.col(variables)).alias("found")
        )
        .where("id is not null and size(found) > 0")
        .select("id", "kind", F.size("found").alias("n"), F.explode("found").alias("ident"))
    )
    # materialised, so that both sides of the join below are plain exchanges, which AQE can split where one is skewed
    first = cut(
        held.groupBy(F.col("ident").alias("i"))
        .agg(F.min("id").alias("first"), F.min("kind").alias("k1"), F.max("kind").alias("k2"))
        .where("k1 <> k2")
        .select("i", "first")
    )
    linked = held.join(first, F.col("ident") == F.col("i")).select("id", "n", "first")
    several = linked.where("n > 1").groupBy("id").agg(F.min("first").alias("first"), F.collect_set("first").alias("all"))
    edges = several.select("first", F.explode("all").alias("other"))
    roots = components(edges, "first", "other", most)
    return (
        linked.where("n = 1")
        .select("id", "first")
        .unionByName(several.select("id", "first"))
        .join(roots, F.col("first") == F.col("node"), "left")
        .select("id", F.coalesce("root", "first").alias("group_id"))
    )
