"""The pattern store: Parquet tables in versions, switched by their success marker.

``sources, open_lines`` and ``tags`` are written whole per version. ``templates, fingerprints`` and ``occurrences`` get
what a version changes or adds, and are now and then written whole up to a version, so that neither a step nor a reader
pays for the number of versions before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.tokens import render

SCHEMAS = {
    "sources": "source string, group string, position bigint",
    "templates": "pattern_id bigint, group string, tokens array<string>",
    "fingerprints": "source string, fingerprint string, n bigint",
    "open_lines": "group string, source string, byte_offset bigint, next_offset bigint, line string",
    "occurrences": "pattern_id bigint, group string, source string, byte_offset bigint, entry_timestamp bigint, variables array<string>",
    "tags": "pattern_id bigint, tag string",
}


#: Tables of which a version holds what it changed or added, with the key of which the newest row counts (none: all rows).
CHANGES = {"templates": "pattern_id", "fingerprints": None, "occurrences": None}
#: Versions after which the changes are written whole.
VERSIONS_APART = 32


class Store:
    """A version written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = self.path.rsplit("/", 1)[-1]

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, name: str, what: str = "version") -> list[int]:
        fs, root = self._fs(f"{self.path}/{name}")
        if not fs.exists(root):
            return []
        out = []
        for s in fs.listStatus(root):
            part = s.getPath().getName()
            if part.startswith(what + "=") and fs.exists(self._fs(f"{self.path}/{name}/{part}/_SUCCESS")[1]):
                out.append(int(part.split("=")[1]))
        return sorted(out)

    def next_version(self) -> int:
        return max([-1, *self.versions("sources")]) + 1

    def size(self) -> int:
        """Bytes of all files of the store."""
        fs, root = self._fs(self.path)
        return fs.getContentSummary(root).getLength() if fs.exists(root) else 0

    def _folder(self, name: str, part: str, number: int) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}/{part}={number}")

    def read_version(self, name: str, version: int) -> DataFrame:
        """What a version holds; empty if there is none."""
        return self._folder(name, "version", version) if version in self.versions(name) else self.spark.createDataFrame([], SCHEMAS[name])

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """A table as of its newest finished version (before ``before``); empty if there is none."""
        have = [v for v in self.versions(name) if before is None or v < before]
        if name not in CHANGES:
            return self._folder(name, "version", have[-1]) if have else self.spark.createDataFrame([], SCHEMAS[name])
        whole = [v for v in self.versions(name, "whole") if before is None or v < before][-1:]
        # those of steps that were finished
        have = sorted(v for v in set(have) & set(self.versions("sources")) if not whole or v > whole[0])
        key = CHANGES[name]
        parts = [self._folder(name, "whole", v) for v in whole]
        if have and not key:
            parts.append(self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.path}/{name}/version={v}" for v in have)))
        elif have:
            dated = [self._folder(name, "version", v).withColumn("_v", F.lit(v)) for v in have]
            dated += [p.withColumn("_v", F.lit(-1)) for p in parts]
            both = dated[0]
            for other in dated[1:]:
                both = both.unionByName(other)
            rest = [c for c in both.columns if c not in (key, "_v")]
            newest = both.groupBy(key).agg(F.max_by(F.struct(*rest), "_v").alias("_r"))
            return newest.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))
        out = parts[0] if parts else self.spark.createDataFrame([], SCHEMAS[name])
        for other in parts[1:]:
            out = out.unionByName(other)
        return out

    def write(self, name: str, df: DataFrame, version: int, part: str = "version") -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/{part}={version}")

    def compact(self, before: int | None = None) -> None:
        """Write the tables of changes whole, up to the newest finished version (before ``before``), and drop what went
        into that. Readers that began earlier must have ended; a failure in between leaves all as it was."""
        done = [v for v in self.versions("sources") if before is None or v < before]
        if not done:
            return
        for name in CHANGES:
            if done[-1] in self.versions(name, "whole"):
                continue
            self.write(name, self.read(name, before), done[-1], "whole")
            for part in ("version", "whole"):
                for v in self.versions(name, part):
                    if v < done[-1] or (part == "version" and v == done[-1]):
                        fs, p = self._fs(f"{self.path}/{name}/{part}={v}")
                        fs.delete(p, True)

    def tidy(self, version: int) -> None:
        """``compact`` before ``version``, where enough versions have come since the last time."""
        last = max([-1, *self.versions("templates", "whole")])
        if version - last > VERSIONS_APART:
            self.compact(version)

    def replace_tags(self, tags: DataFrame) -> None:
        self.write("tags", tags, max([-1, *self.versions("tags")]) + 1)

    def model(self) -> dict[str, DataFrame]:
        """``patterns, file_groups, occurrences, log_sources, tags`` with the columns that the operators expect."""
        occ, src, tpl = self.read("occurrences"), self.read("sources"), self.read("templates")
        key = lambda c: F.xxhash64(F.col(c))
        counts = occ.groupBy(F.col("pattern_id").alias("p")).agg(F.count("*").alias("occurrence_count"))
        return {
            "file_groups": src.select(key("group").alias("id"), F.col("group").alias("name")).distinct(),
            "log_sources": src.select(
                key("source").alias("id"), F.col("source").alias("file_path"), key("group").alias("file_group_id"),
                F.col("position").alias("last_processed_position"), F.lit(None).cast("string").alias("file_hash"),
            ),
            "patterns": tpl.join(counts, F.col("pattern_id") == F.col("p"), "left").select(
                F.col("pattern_id").alias("id"), key("group").alias("file_group_id"), render(F.col("tokens")).alias("template"),
                F.coalesce("occurrence_count", F.lit(0)).alias("occurrence_count"),
            ),
            "occurrences": occ.select(
                F.xxhash64("source", "byte_offset").alias("id"), key("source").alias("log_source_id"), "pattern_id",
                "byte_offset", "entry_timestamp", F.array_join("variables", "\t").alias("variables"),
            ),
            "tags": self.read("tags"),
        }
