"""Records of several sources combined so that each contributes its target share of all tokens.

Method: Sainte-Lague apportionment. The tokens of a source form blocks of equal size; blocks of the mixture go to sources
by highest quotients share / (2 s + 1), a source leaving when its blocks times its repeats are used up; a source's blocks
go to its shards the same way, and within a shard a seeded order selects them.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.session import cut, spread

TOKENIZER = os.environ.get("STRATALOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published pattern that cuts text into pieces before byte-pair encoding (GPT-2).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a block, records of a shard about, and shards at most.
BLOCK_TOKENS, SHARD_ROWS, MOST_SHARDS = 512, 50_000, 4_096


def apportion(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients w / (2 s + 1), none beyond its cap; ties go to the one listed first.

    Weights of 0 or less get nothing. If the caps end before the seats do, the rest stays unassigned.
    """
    n = len(weights)
    live = [w > 0 and c > 0 for w, c in zip(weights, caps, strict=True)]
    seats = min(seats, sum(c for c, ok in zip(caps, live, strict=True) if ok))
    if seats <= 0:
        return [0] * n
    most = max(w for w, ok in zip(weights, live, strict=True) if ok)
    # with divisor 1 / x, source i has floor(w x + 1/2) seats: bisect for an x that gives no more than all
    given = lambda x: [min(c, int(w * x + 0.5)) if ok else 0 for w, c, ok in zip(weights, caps, live, strict=True)]
    lo, hi = 0.0, 1.0 / most
    while sum(given(hi)) < seats:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(given(mid)) <= seats else (lo, mid)
    out = given(lo)
    rest = [(-weights[i] / (2 * out[i] + 1), i) for i in range(n) if live[i] and out[i] < caps[i]]
    heapq.heapify(rest)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(rest)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(rest, (-weights[i] / (2 * out[i] + 1), i))
    return out


def _count_tokens(name: str):
    """Tokens per text; ``name`` is that of a vocabulary file which the session has sent to the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            texts = batch.column(2).to_pylist()
            counts = pa.array([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["doc_id", "source", "tokens"])

    return run


def source_name(col: Column) -> Column:
    """A source's name without letter case, outer blanks and ``-`` for ``_``; blank is null."""
    name = F.lower(F.regexp_replace(F.trim(col), "-", "_"))
    return F.when(name != "", name)


class Mixture:
    """The apportionment of ``documents`` to ``targets`` (``source, target_share, max_repeats``).

    Documents without source, of sources that no target names, and without text take no part. A null or negative share
    or repeat is 0; of repeated target names the shares are added and the greatest repeat holds. ``total_tokens``: the
    size wanted, by default all tokens of the target sources once. The driver gets the targets and one number per source
    and shard, at most 4,096 shards.
    """

    def __init__(
        self, documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        total_tokens: int | None = None, block: int = BLOCK_TOKENS, seed: int = 17, tokenizer: str = TOKENIZER,
        shard_rows: int = SHARD_ROWS,
    ):
        self.spark, self.block, self.seed = documents.sparkSession, block, seed
        self.spark.sparkContext.addFile(tokenizer)  # the executors need no copy of their own
        wanted = (
            targets.select(
                source_name(F.col("source")).alias("source"),
                F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0)).alias("share"),
                F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0)).alias("repeats"),
            )
            .where("source is not null")
            .groupBy("source")
            .agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats"))
            .orderBy("source")
            .collect()
        )
        self.targets = [(r["source"], float(r["share"]), int(r["repeats"])) for r in wanted]
        names = [t[0] for t in self.targets]
        counted = (
            spread(
                documents.select(
                    F.col(doc_id).cast("bigint").alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text")
                ).where(F.col("source").isin(names) & F.col("text").isNotNull())
            )
            .mapInArrow(_count_tokens(os.path.basename(tokenizer)), "doc_id bigint, source string, tokens bigint")
            .where("tokens > 0")
        )
        self.counted = cut(counted)
        self.shards = min(MOST_SHARDS, max(1, -(-self.counted.count() // shard_rows)))
        self.placed = self.counted.withColumn(
            "shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(self.shards)).cast("int")
        )
        sizes = self.placed.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).collect()
        self.tokens = {(r["source"], r["shard"]): r["tokens"] for r in sizes}
        self.total = sum(self.tokens.values()) if total_tokens is None else total_tokens
        self._apportion()

    def _apportion(self) -> None:
        blocks = {k: -(-v // self.block) for k, v in self.tokens.items()}
        have = {s: sum(blocks.get((s, h), 0) for h in range(self.shards)) for s, _, _ in self.targets}
        caps = [have[s] * r for s, _, r in self.targets]
        quota = apportion([w for _, w, _ in self.targets], caps, -(-self.total // self.block))
        self.quota = {s: q for (s, _, _), q in zip(self.targets, quota, strict=True)}
        self.rounds: list[tuple[str, int, int, int]] = []
        for s, _, repeats in self.targets:
            own = [(h, blocks[s, h]) for h in range(self.shards) if (s, h) in blocks]
            each = apportion([n for _, n in own], [n * repeats for _, n in own], self.quota[s])
            self.rounds += [(s, h, *divmod(q, n)) for (h, n), q in zip(own, each, strict=True)]

    def pieces(self) -> DataFrame:
        """``source, shard, block, doc_id, from_token, n_tokens, uses``: what of each document goes in how often."""
        order = [F.xxhash64("doc_id", F.lit(self.seed + 1)), F.col("doc_id"), F.col("tokens")]
        stream = W.partitionBy("source", "shard").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        size = F.lit(self.block)
        cut_up = (
            self.placed.withColumn("at", F.coalesce(F.sum("tokens").over(stream), F.lit(0)))
            .withColumn(
                "block",
                F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("tokens") - 1) / size))),
            )
            .withColumn("lo", F.greatest("at", F.col("block") * size))
            .withColumn("hi", F.least(F.col("at") + F.col("tokens"), (F.col("block") + 1) * size))
        )
        rank = W.partitionBy("source", "shard").orderBy(F.xxhash64("source", "shard", "block", F.lit(self.seed)), "block")
        rounds = self.spark.createDataFrame(self.rounds, "s string, h int, full bigint, extra bigint")
        return (
            cut_up.withColumn("no", F.dense_rank().over(rank))
            # at most 4,096 rows per target
            .join(F.broadcast(rounds), (F.col("source") == F.col("s")) & (F.col("shard") == F.col("h")))
            .withColumn("uses", F.col("full") + F.when(F.col("no") <= F.col("extra"), 1).otherwise(0))
            .where("uses > 0")
            .select(
                "source",
                "shard",
                "block",
                "doc_id",
                (F.col("lo") - F.col("at")).alias("from_token"),
                (F.col("hi") - F.col("lo")).alias("n_tokens"),
                "uses",
            )
        )

    def shares(self) -> DataFrame:
        """Per target: ``source, target_share, max_repeats, available_tokens, quota_blocks, tokens, share_reached,
        most_uses``. Sources absent or short show what they reached; without any token all shares are 0."""
        used = self.pieces().groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses")
        )
        have: dict[str, int] = {}
        for (s, _), n in self.tokens.items():
            have[s] = have.get(s, 0) + n
        rows = [(s, w, r, have.get(s, 0), self.quota[s]) for s, w, r in self.targets]
        listed = self.spark.createDataFrame(
            rows, "name string, target_share double, max_repeats int, available_tokens bigint, quota_blocks bigint"
        )
        whole = used.agg(F.sum("tokens")).scalar()
        return (
            listed.join(used, F.col("name") == F.col("source"), "left")
            .select(
                F.col("name").alias("source"),
                "target_share",
                "max_repeats",
                "available_tokens",
                "quota_blocks",
                F.coalesce("tokens", F.lit(0)).alias("tokens"),
                F.round(F.coalesce(F.col("tokens") / whole, F.lit(0.0)), 6).alias("share_reached"),
                F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            )
        )
