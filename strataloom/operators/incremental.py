"""Processing only what was added or changed since the last successful run.

Method: every partition of the input has a fingerprint, its row count and the sum of its row hashes. Partitions whose
fingerprint differs from the stored one are recomputed and replaced as a whole by dynamic partition overwrite; the new
fingerprints are committed only after that, so a run that fails in between is simply done again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.session import cut, small

#: Partitions at least and at most (whose numbers reach the driver), and rows that one should hold about.
LEAST_PARTS, MOST_PARTS, PART_ROWS = 64, 16_384, 4_000_000


class IncrementalTable:
    """A derived table at ``path``, kept up to date partition by partition.

    ``keys`` assign rows to ``parts`` partitions by hash; only the numbers of changed partitions reach the driver. Every
    row carries the run that wrote it, ``_run``, and the state the run that last computed each partition, so what a
    partition held before is never read again, also where it came out empty.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], parts: int = LEAST_PARTS):
        self.spark, self.path, self.keys, self.parts = spark, path, keys, parts

    def placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_part", F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def fingerprints(self, df: DataFrame) -> DataFrame:
        """``_part, n, h1, h2`` for the partitions that have rows. Order of rows and of files doesn't matter."""
        row = [c for c in sorted(df.columns) if c != "_part"]
        wide = lambda *seed: F.sum(F.xxhash64(*seed, *row).cast("decimal(20,0)"))
        return self.placed(df).groupBy("_part").agg(
            F.count("*").alias("n"), wide().alias("h1"), wide(F.lit(1)).alias("h2")
        )

    def _runs(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_state")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(
            int(p.getName().split("=")[1])
            for p in names
            if p.getName().startswith("run=")
            and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        )

    def stored(self) -> DataFrame | None:
        """Fingerprints of the last committed run: ``_part, n, h1, h2, made``."""
        runs = self._runs()
        return self.spark.read.parquet(f"{self.path}/_state/run={runs[-1]}") if runs else None

    def prepare(
        self, current: DataFrame, compute: Callable[[DataFrame], DataFrame], prior: DataFrame | None = None
    ) -> list[int]:
        """Recompute the partitions in which ``current`` differs from the last committed run; returns their numbers.

        ``prior`` stands in for the stored fingerprints where no run has been committed. ``compute`` gets whole
        partitions, with the column ``_part``, which it must keep. Nothing is committed: until ``commit``, the next call
        does the same again.
        """
        stored = self.stored()
        self.version = max(self._runs(), default=0) + 1
        now = cut(self.fingerprints(current))
        before = stored if stored is not None else prior
        if before is None:
            changed = [r[0] for r in now.select("_part").collect()]
        else:
            old = before.select(F.col("_part").alias("p"), F.struct("n", "h1", "h2").alias("was"))
            new = now.select("_part", F.struct("n", "h1", "h2").alias("is"))
            differ = new.join(old, F.col("_part") == F.col("p"), "full").where(~F.col("is").eqNullSafe(F.col("was")))
            changed = [r[0] for r in differ.select(F.coalesce("_part", "p")).collect()]
        if changed or stored is None:
            rows = compute(self.placed(current).where(F.col("_part").isin(changed)))
            self.replace("data", rows)
        made = F.when(F.col("_part").isin(changed), F.lit(self.version))
        if stored is None:
            self.state = now.withColumn("made", F.coalesce(made, F.lit(0)))
        else:
            last = stored.select(F.col("_part").alias("p"), F.col("made").alias("before"))
            self.state = now.join(last, F.col("_part") == F.col("p"), "left").select(
                *now.columns, F.coalesce(made, "before", F.lit(0)).alias("made")
            )
        return sorted(changed)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write ``rows`` as those of their partitions in the table ``name``, each replaced as a whole."""
        (
            rows.withColumn("_run", F.lit(self.version))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("_part")
            .parquet(f"{self.path}/{name}")
        )

    def commit(self) -> None:
        """Make the prepared run the last successful one."""
        self.state.write.mode("overwrite").parquet(f"{self.path}/_state/run={self.version}")

    def run(
        self, current: DataFrame, compute: Callable[[DataFrame], DataFrame], prior: DataFrame | None = None
    ) -> list[int]:
        """Bring the table up to ``current``; returns the partitions recomputed."""
        changed = self.prepare(current, compute, prior)
        self.commit()
        return changed

    def rows(self, name: str, schema: str, state: DataFrame) -> DataFrame:
        """Rows of a table as ``state`` knows them, with ``_run``; partitions that vanished or are older are left out."""
        rows = self.spark.read.schema(f"{schema}, _run int").parquet(f"{self.path}/{name}")
        live = state.select(F.col("_part").alias("p"), F.col("made").cast("int").alias("m"))
        # a row per partition, at most MOST_PARTS
        return rows.join(F.broadcast(live), (F.col("_part") == F.col("p")) & (F.col("_run") == F.col("m")), "left_semi")

    def read(self, schema: str) -> DataFrame:
        """The derived table as the last committed run left it."""
        return self.rows("data", schema, self.stored()).drop("_run")


def bare_hash(col):
    """A hash without letter case, algorithm prefix and padding; blank is null."""
    text = F.lower(F.regexp_replace(F.trim(col), r"^.*:\s*", ""))
    return F.when(text != "", text)


def source_starts(log_sources: DataFrame, scans: DataFrame) -> DataFrame:
    """``log_source_id, start``: per source with a complete scan, the offset from which entries are to be processed.

    The newest complete scan counts (ties: the highest ``scan_id``). ``start`` is null where all of the source is to be
    processed: the file is shorter than the position reached, or both hashes are there and differ. A source that
    ``log_sources`` lacks, or whose position is null, starts at 0. A scan without ``file_size`` says nothing of it.
    """
    newest = (
        scans.where((F.col("status") == "complete") & F.col("log_source_id").isNotNull())
        .groupBy(F.col("log_source_id").alias("sid"))
        .agg(F.max(F.struct("scanned_at", "scan_id", "file_size", "file_hash")).alias("s"))
    )
    known = log_sources.select(
        F.col("id"), F.coalesce("last_processed_position", F.lit(0)).alias("pos"), F.col("file_hash").alias("was")
    )
    old, new = bare_hash(F.col("was")), bare_hash(F.col("s.file_hash"))
    reset = F.coalesce(F.col("s.file_size") < F.col("pos"), F.lit(False)) | F.coalesce(old != new, F.lit(False))
    return newest.join(known, F.col("sid") == F.col("id"), "left").select(
        F.col("sid").alias("log_source_id"),
        F.when(~reset, F.coalesce("pos", F.lit(0))).alias("start"),
    )


class PendingEntries:
    """The entries added or changed since the last successful run, kept at ``path``.

    ``rows``: ``log_source_id, byte_offset``, each entry once. Due are the entries that ``source_starts`` leaves to be
    processed, and those whose content is another than that which the last committed run saw at their place. ``commit``
    makes this run the last successful one; without it the next one gives the same rows again, and with it none twice
    once ``log_sources`` has the new positions. Entries without source or offset are left out; of repeated rows of an
    entry the greatest content hash stands for all. Empty tables give no rows.

    Before the first commit the entries before a source's start are taken as seen; their fingerprints are the prior
    state. ``parts``, by default from the number of entries, is fixed by the first commit.
    """

    def __init__(
        self, spark: SparkSession, raw: DataFrame, log_sources: DataFrame, scans: DataFrame, path: str, content: str = "raw_message",
        parts: int | None = None,
    ):
        entries = (
            raw.where("log_source_id is not null and byte_offset is not null")
            .groupBy("log_source_id", "byte_offset")
            .agg(F.max(F.xxhash64(content)).alias("content"))
        )
        # sent to all tasks if small; else a plain table, against which AQE can split a source with many rows
        starts = small(cut(source_starts(log_sources, scans).withColumnRenamed("log_source_id", "sid")))
        # a block of a source, not a source, is the unit: one source may hold a third of all rows
        self.keyed = entries.join(starts, F.col("log_source_id") == F.col("sid")).select(
            "log_source_id", "byte_offset", "content", F.coalesce(F.col("byte_offset") < F.col("start"), F.lit(False)).alias("done"),
            F.floor(F.col("byte_offset") / F.lit(1 << 22)).alias("block"),
        )
        self.work = IncrementalTable(spark, path, ["log_source_id", "block"])
        stored = self.work.stored()
        if stored is not None:
            parts = stored.select(F.max("parts")).first()[0] or parts
        if parts is None:
            parts = min(MOST_PARTS, max(LEAST_PARTS, -(-raw.count() // PART_ROWS)))
        self.work.parts = parts
        seen = None
        if stored is not None:
            seen = self.work.rows("seen", _SEEN, stored.withColumn("made", F.col("seen"))).select(
                F.col("log_source_id").alias("s"), F.col("byte_offset").alias("o"), F.col("content").alias("was"), F.col("_part").alias("p")
            )

        def due(rows: DataFrame) -> DataFrame:
            if seen is None:
                found = rows.where("not done").withColumn("moved", F.lit(True))
            else:
                held = rows.join(seen, (F.col("_part") == F.col("p")) & (F.col("log_source_id") == F.col("s")) & (F.col("byte_offset") == F.col("o")), "left")
                found = held.withColumn("moved", ~F.col("done")).where("moved or content <> was")
            return found.select("log_source_id", "byte_offset", "moved", "_part")

        prior = None if stored is not None else self.work.fingerprints(self.keyed.where("done"))
        self.changed = self.work.prepare(self.keyed, due, prior)
        rows = self.work.rows("data", "log_source_id bigint, byte_offset bigint, moved boolean, _part int", self.work.state)
        # what an earlier run found changed in place is due again only if its partition was computed anew
        self.rows = rows.where(F.col("moved") | (F.col("_run") == self.work.version)).select("log_source_id", "byte_offset")

    def commit(self) -> None:
        work, stored = self.work, self.work.stored()
        placed = work.placed(self.keyed).select("log_source_id", "byte_offset", "content", "_part")
        fresh = F.lit(True) if stored is None else F.col("_part").isin(self.changed)
        work.replace("seen", placed.where(fresh))
        seen = F.when(fresh, F.lit(work.version))
        if stored is None:
            work.state = work.state.withColumn("seen", seen)
        else:
            last = stored.select(F.col("_part").alias("p"), F.col("seen").alias("s"))
            work.state = work.state.join(last, F.col("_part") == F.col("p"), "left").withColumn("seen", F.coalesce(seen, "s")).drop("p", "s")
        work.state = work.state.withColumn("parts", F.lit(work.parts))
        work.commit()


_SEEN = "log_source_id bigint, byte_offset bigint, content bigint, _part int"


def entries_to_process(
    spark: SparkSession, raw: DataFrame, log_sources: DataFrame, scans: DataFrame, path: str, parts: int | None = None
) -> DataFrame:
    """``log_source_id, byte_offset`` of the entries that ``PendingEntries`` finds due, without committing the run."""
    return PendingEntries(spark, raw, log_sources, scans, path, parts=parts).rows
