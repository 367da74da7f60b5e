"""Lines into the store, batch by batch: the same step serves a run over files and a stream that follows them.

The last entry of each source is held back until lines after it show that it is complete, so a stream of small batches
gives what one batch gives. Each step reads the state of the version before its own and writes its own, so a step that
is repeated after a failure replaces what it wrote.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.tokens import group_name, render, variables
from strataloom.operators import mining, structure
from strataloom.session import cut
from strataloom.sources.logs import read_lines, register
from strataloom.store import Store


def assign(vectors: DataFrame, known: DataFrame, threshold: float, most: int = mining.VECTORS_PER_FOLD) -> DataFrame:
    """``group, masked, pattern_id, tokens``: the vectors with their templates after all were taken in, and with null
    ``masked`` every template of their groups and token counts. Known templates keep their ids, however they evolve."""

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = mining.PrefixTree(threshold)
        ids: list[int] = []
        for v, i in pdf[pdf["n"] == 0].sort_values("pattern_id")[["masked", "pattern_id"]].itertuples(index=False):
            tree.seed(list(v))
            ids.append(int(i))
        rows = pdf[pdf["n"] > 0].sort_values(["first_source", "first_offset"], kind="stable")
        took = []
        for v, i in rows[["masked", "pattern_id"]].itertuples(index=False):
            at = tree.add(list(v))
            if at == len(ids):
                ids.append(int(i))
            took.append(at)
        group = pdf["group"].iloc[0]
        out = [(group, list(v), ids[a], tree.templates[a]) for v, a in zip(rows["masked"], took, strict=True)]
        out += [(group, None, i, t) for i, t in zip(ids, tree.templates, strict=True)]
        return pd.DataFrame(out, columns=["group", "masked", "pattern_id", "tokens"])

    fresh = vectors.select(
        "group", "masked", "n", F.col("first.source").alias("first_source"), F.col("first.byte_offset").alias("first_offset"),
        mining.pattern_id(F.col("group"), render(F.col("masked"))).alias("pattern_id"),
    )
    met = vectors.select(F.col("group").alias("_g"), F.size("masked").alias("_s")).distinct()
    near = known.join(met, F.col("group").eqNullSafe(F.col("_g")) & (F.size("tokens") == F.col("_s")), "left_semi")
    seeds = near.select(
        "group", F.col("tokens").alias("masked"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("first_source"),
        F.lit(0).cast("bigint").alias("first_offset"), "pattern_id",
    )
    both = mining.fold_units(fresh.unionByName(seeds), most)
    return both.groupBy("group", "size", "unit").applyInPandas(
        folded, "group string, masked array<string>, pattern_id bigint, tokens array<string>"
    )


def step(store: Store, lines: DataFrame, version: int, last: bool = False, threshold: float = mining.THRESHOLD, syslog_year: int = 2026) -> None:
    """Take ``lines`` (``group, source, byte_offset, next_offset, line``) into the store as ``version``.

    ``last`` lets go of the entries held back. A source whose lines begin below its position has been replaced; its
    position follows.
    """
    before = version
    store.tidy(version)
    new = cut(lines)
    positions = store.read("sources", before)
    # a replaced file begins anew: what is held back of the old one is a unit of its own, and complete
    replaced = (
        new.groupBy(F.col("source").alias("_n"))
        .agg(F.min("byte_offset").alias("_least"))
        .join(positions, F.col("_n") == F.col("source"))
        .where(F.col("_least") < F.col("position"))
        .select("_n")
    )
    held = (
        store.read("open_lines", before)
        .join(replaced, F.col("source") == F.col("_n"), "left")
        .withColumn("unit", F.when(F.col("_n").isNotNull(), F.concat("source", F.lit("\n"))).otherwise(F.col("source")))
        .drop("_n")
    )
    all_lines = cut(new.withColumn("unit", F.col("source")).unionByName(held))
    known = store.read("fingerprints", before)
    learnt = structure.entry_fingerprints(all_lines, "source", "line")
    unseen = learnt.join(known.select(F.col("source").alias("_k")).distinct(), F.col("source") == F.col("_k"), "left_anti")
    unseen = cut(unseen)
    prints = known.unionByName(unseen)
    marked = structure.mark_starts(all_lines, "source", "line", prints)
    if last:
        ready, kept = marked, None
    else:
        ends = marked.where("is_start").groupBy(F.col("unit").alias("_e")).agg(F.max("byte_offset").alias("_end"))
        split = cut(
            marked.join(ends, F.col("unit") == F.col("_e"), "left").withColumn(
                "_open", ~F.col("unit").endswith("\n") & (F.col("_end").isNull() | (F.col("byte_offset") >= F.col("_end")))
            )
        )
        kept = split.where("_open").select(*lines.columns)
        ready = split.where("not _open").select(*marked.columns)
    groups = all_lines.groupBy("source").agg(F.min("group").alias("group"))
    whole = structure.group_entries(ready, "unit", "byte_offset", "next_offset", "line")
    entries = whole.withColumn("source", F.regexp_replace("source", "\n$", "")).join(
        groups.withColumnRenamed("source", "_g"), F.col("source") == F.col("_g")
    )
    tokens = cut(mining.tokenized(entries, "group", "source", "byte_offset", "primary_line", "continuation", syslog_year))
    templates = store.read("templates", before)
    found = cut(assign(mining.distinct_vectors(tokens), templates, threshold))
    by_vector = found.where("masked is not null").select(
        F.col("group").alias("_vg"), F.col("masked").alias("_m"), "pattern_id", F.col("tokens").alias("_t")
    )
    occurrences = tokens.join(by_vector, (F.col("group") == F.col("_vg")) & (F.col("masked") == F.col("_m"))).select(
        "pattern_id", "group", "source", "byte_offset", "entry_timestamp", variables(F.col("_t"), F.col("tokens")).alias("variables")
    )
    store.write("occurrences", occurrences, version)
    old = templates.select(F.col("pattern_id").alias("_p"), F.col("tokens").alias("_was"))
    changed = found.where("masked is null").join(old, (F.col("pattern_id") == F.col("_p")) & (F.col("tokens") == F.col("_was")), "left_anti")
    store.write("templates", changed.select("pattern_id", "group", "tokens"), version)
    store.write("fingerprints", unseen, version)
    store.write("open_lines", kept if kept is not None else new.limit(0), version)
    old = positions.select(F.col("source").alias("_o"), F.col("group").alias("_og"), F.col("position").alias("_op"))
    reached = new.groupBy("source").agg(F.min("group").alias("group"), F.max("next_offset").alias("position"))
    sources = reached.join(old, F.col("source") == F.col("_o"), "full").select(
        F.coalesce("source", "_o").alias("source"), F.coalesce("group", "_og").alias("group"), F.coalesce("position", "_op").alias("position")
    )
    store.write("sources", sources, version)  # last: its marker makes the version count


def placed_lines(lines: DataFrame, group: str | None = None) -> DataFrame:
    name = F.lit(group) if group else group_name(F.col("file_path"))
    return lines.select(name.alias("group"), F.col("file_path").alias("source"), "byte_offset", "next_offset", "line")


def process(spark: SparkSession, store: Store, paths: str, group: str | None = None, threshold: float = mining.THRESHOLD, syslog_year: int = 2026) -> None:
    """Read what files hold beyond the positions reached, and let the step finish all entries."""
    positions = {r["source"]: r["position"] for r in store.read("sources").collect()}  # one row per file
    lines = placed_lines(read_lines(spark, paths, positions, max_line=None), group)
    step(store, lines, store.next_version(), True, threshold, syslog_year)


def _first_version(spark: SparkSession, store: Store, checkpoint: str) -> int:
    """The version of a stream's batch 0; kept beside its checkpoint, so that a batch done again has its old version."""
    fs, path = store._fs(f"{checkpoint}/first_version")
    if not fs.exists(path):
        row = spark.createDataFrame([(store.next_version(),)], "version bigint")
        row.write.parquet(f"{checkpoint}/first_version")
    return spark.read.parquet(f"{checkpoint}/first_version").first()[0]


def watch(
    spark: SparkSession,
    store: Store,
    paths: str,
    checkpoint: str,
    group: str | None = None,
    threshold: float = mining.THRESHOLD,
    syslog_year: int = 2026,
    trigger: dict | None = None,
    alert: Callable[[DataFrame], None] | None = None,
    tell: Callable[[DataFrame], None] | None = None,
):
    """Follow files as a stream; returns the running query. ``alert`` gets the store's anomalies after each batch, and
    ``tell`` the batch's new entries as ``source, new_entries``, where there are any."""
    register(spark)
    positions = {r["source"]: r["position"] for r in store.read("sources").collect()}  # one row per file
    first = _first_version(spark, store, checkpoint)
    lines = spark.readStream.format("loglines").option("paths", paths).option("positions", json.dumps(positions)).option("max_line", "0").load()

    def take(batch: DataFrame, batch_id: int) -> None:
        step(store, placed_lines(batch, group), first + batch_id, False, threshold, syslog_year)
        if tell is not None:
            new = store.read_version("occurrences", first + batch_id).groupBy("source").agg(F.count("*").alias("new_entries"))
            if not new.isEmpty():
                tell(new.orderBy("source"))
        if alert is not None:
            from strataloom.operators.compare import anomalies

            m = store.model()
            alert(anomalies(m["patterns"], m["file_groups"], m["occurrences"], m["log_sources"], 10))

    return (
        lines.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def finish(store: Store, threshold: float = mining.THRESHOLD, syslog_year: int = 2026) -> None:
    """Take in the entries that the stream held back."""
    none = store.spark.createDataFrame([], "group string, source string, byte_offset bigint, next_offset bigint, line string")
    step(store, none, store.next_version(), True, threshold, syslog_year)
