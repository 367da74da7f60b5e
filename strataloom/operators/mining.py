"""Templates out of token vectors, declaratively or by a prefix-tree fold over distinct vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.bind import bind
from strataloom.functions.stamps import extract_timestamp
from strataloom.functions.tokens import PINNED, WILDCARD, entry_tokens, mask, render, variables
from strataloom.session import cut, ship, small, spread

#: Fixed values of the fold: similarity to join a template, similarity that ends the search; templates of a leaf looked at in
#: parity with the reference.
THRESHOLD, EARLY_EXIT, MOST_CANDIDATES = 0.5, 0.9, 50


def tokenized(
    entries: DataFrame,
    group: str,
    source: str,
    offset: str,
    line: str,
    continuation: str | None = None,
    syslog_year: int = 2026,
) -> DataFrame:
    """``group, source, byte_offset, entry_timestamp, tokens, masked`` of entries that have tokens."""
    more = F.col(continuation) if continuation else F.array().cast("array<string>")
    slim = spread(
        entries.select(
            F.col(group).alias("group"),
            F.col(source).cast("string").alias("source"),
            F.col(offset).alias("byte_offset"),
            F.col(line).alias("line"),
            more.alias("more"),
        )
    )
    cut_up = bind(slim, tokens=entry_tokens(F.col("line"), F.col("more"))).where(F.size("tokens") > 0)
    return bind(cut_up, masked=mask(F.col("tokens"))).select(
        "group", "source", "byte_offset", extract_timestamp(F.col("line"), syslog_year).alias("entry_timestamp"), "tokens", "masked"
    )


def distinct_vectors(tokens: DataFrame) -> DataFrame:
    """Masked vectors per group with their number of entries and the first of them. Mining needs nothing else."""
    return tokens.groupBy("group", "masked").agg(
        F.count("*").alias("n"), F.min(F.struct("source", "byte_offset")).alias("first")
    )


def strict_templates(vectors: DataFrame) -> DataFrame:
    """``group, masked, n, template`` without any order: vectors of one length, the same first 14 tokens and the same line
    breaks share a template, which has a wildcard wherever they differ.

    Equal to the fold for up to 28 tokens as long as no literal falls back on a wildcard's branch.
    """
    breaks = F.filter(
        F.transform("masked", lambda t, i: F.when(t == "\n", i).otherwise(-1)), lambda i: i >= 0
    )
    keyed = vectors.select(
        "group",
        "masked",
        "n",
        F.size("masked").alias("size"),
        F.slice("masked", 1, PINNED).alias("pinned"),
        breaks.alias("breaks"),
    )
    short = keyed.where(F.col("size") <= PINNED).select("group", "masked", "n", F.col("masked").alias("template"))
    key = ["group", "size", "pinned", "breaks"]
    long = keyed.where(F.col("size") > PINNED)
    tails = (
        long.select(*key, F.posexplode("masked").alias("at", "token"))
        .groupBy(*key, "at")
        .agg(F.min("token").alias("lo"), F.max("token").alias("hi"))
        .select(*key, "at", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(WILDCARD).alias("token"))
        .groupBy(*key)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("template"))
    )
    return short.unionByName(long.join(tails, key).select("group", "masked", "n", "template"))


class PrefixTree:
    """Templates of one token count, by their first tokens; a token that isn't there falls back on the wildcard.

    ``most`` (off by default, parity is ``MOST_CANDIDATES``) bounds the templates of a leaf that are looked at."""

    def __init__(self, threshold: float = THRESHOLD, most: int | None = None):
        self.threshold, self.most, self.root, self.templates = threshold, most, {}, []

    def _leaf(self, vector: list[str]) -> list[int] | None:
        node = self.root
        for token in vector[:PINNED]:
            node = node.get(token) or node.get(WILDCARD)
            if node is None:
                return None
        return node.get("") if vector else None

    def match(self, vector: list[str]) -> int | None:
        best, best_score = None, 0.0
        for i in (self._leaf(vector) or [])[: self.most]:
            score = self._score(vector, self.templates[i])
            if score >= EARLY_EXIT:
                return i
            if score >= self.threshold and score > best_score:
                best, best_score = i, score
        return best

    @staticmethod
    def _score(vector: list[str], template: list[str]) -> float:
        same = 0
        for v, t in zip(vector, template, strict=True):
            if v == t or (t == WILDCARD and v != "\n"):
                same += 1
            elif "\n" in (v, t):
                return 0.0
        return same / len(vector)

    def add(self, vector: list[str]) -> int:
        """Index of the template that takes the vector in, made more general where they differ."""
        i = self.match(vector)
        if i is not None:
            self.templates[i] = [t if t == v else WILDCARD for v, t in zip(vector, self.templates[i], strict=True)]
            return i
        return self.seed(vector)

    def seed(self, vector: list[str]) -> int:
        node = self.root
        for token in vector[:PINNED]:
            node = node.setdefault(token, {})
        node.setdefault("", []).append(len(self.templates))
        self.templates.append(list(vector))
        return len(self.templates) - 1


#: Distinct vectors that one task folds about.
VECTORS_PER_FOLD = 50_000


def fold_units(vectors: DataFrame, most: int = VECTORS_PER_FOLD, rounds: int = 3) -> DataFrame:
    """``vectors`` (``group, masked``, ...) with ``size`` and ``unit``: vectors of different units never meet in the tree.

    Where all vectors at a node of the tree have a wildcard next, or none has, nothing falls back, and the next tokens lead
    to subtrees that know nothing of each other. So a group and token count is cut by its leading tokens up to the first
    position at which only some have a wildcard, and what comes out is cut again in the same way, as long as more than
    ``most`` vectors are together. Units are hashed into as many parts as ``most`` vectors a part ask for; several units in
    one part don't disturb each other.
    """
    df = cut(vectors.withColumn("size", F.size("masked")).withColumn("unit", F.lit(0).cast("bigint")).withColumn("parts", F.lit(1).cast("bigint")))
    key = ["group", "size", "unit"]
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    for _ in range(rounds):
        wild = [F.get("masked", F.lit(i)) == WILDCARD for i in range(PINNED)]
        mixed = F.array(*(F.max(w) != F.min(w) for w in wild))
        counted = df.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(mixed.alias("_mixed"), F.count("*").alias("_n"))
        large = cut(counted.where(F.col("_n") > most).withColumn("_lead", F.coalesce(F.nullif(F.array_position("_mixed", True), F.lit(0)) - 1, F.lit(PINNED))))
        if large.isEmpty():
            break
        # the parts of a group are those that its first round asks for
        df = (
            df.join(small(large), same, "left")
            .withColumn("unit", F.when(F.col("_n").isNotNull(), F.xxhash64("unit", F.slice("masked", 1, F.col("_lead").cast("int")))).otherwise(F.col("unit")))
            .withColumn("parts", F.greatest("parts", F.coalesce(F.ceil(F.col("_n") / most), F.lit(1))))
            .drop("_mixed", "_n", "_lead", *(f"_{c}" for c in key))
        )
    return df.withColumn("unit", F.pmod("unit", "parts")).drop("parts")


def fold_templates(
    vectors: DataFrame, threshold: float = THRESHOLD, known: DataFrame | None = None, most: int = VECTORS_PER_FOLD
) -> DataFrame:
    """``group, masked, n, template`` by a fold over the distinct vectors in order of first appearance.

    The tree branches first by token count, so every (group, token count) is folded apart, and those of more than
    ``most`` vectors in the parts of ``fold_units``. ``known`` (``group, template`` as token arrays) seeds the trees.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    ship(vectors.sparkSession)

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = PrefixTree(threshold)
        seeds = pdf[pdf["n"] == 0].sort_values("seed_text")
        for v in seeds["masked"]:
            tree.seed(list(v))
        rows = pdf[pdf["n"] > 0].sort_values(["first_source", "first_offset"], kind="stable")
        at = [tree.add(list(v)) for v in rows["masked"]]
        return pd.DataFrame({"group": rows["group"], "masked": rows["masked"], "n": rows["n"], "template": [tree.templates[i] for i in at]})

    slim = vectors.select(
        "group",
        "masked",
        "n",
        F.col("first.source").alias("first_source"),
        F.col("first.byte_offset").alias("first_offset"),
        F.lit("").alias("seed_text"),
    )
    if known is not None:
        slim = slim.unionByName(
            known.select(
                "group", F.col("template").alias("masked"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("first_source"),
                F.lit(0).cast("bigint").alias("first_offset"), render(F.col("template")).alias("seed_text"),
            )
        )
    return (
        fold_units(slim, most)
        .groupBy("group", "size", "unit")
        .applyInPandas(folded, "group string, masked array<string>, n bigint, template array<string>")
    )


def pattern_id(group, template):
    """Stable across runs and inputs."""
    return F.xxhash64(group, template)


def mined_patterns(templates: DataFrame) -> DataFrame:
    """``pattern_id, group, template, tokens, occurrence_count`` of the vectors with their templates, as both ways of
    mining give them; templates of equal text are one pattern."""
    return (
        templates.groupBy("group", F.col("template").alias("tokens"))
        .agg(F.sum("n").alias("occurrence_count"))
        .withColumn("template", render(F.col("tokens")))
        .groupBy("group", "template")
        .agg(F.min("tokens").alias("tokens"), F.sum("occurrence_count").alias("occurrence_count"))
        .select(pattern_id(F.col("group"), F.col("template")).alias("pattern_id"), "group", "template", "tokens", "occurrence_count")
    )


def mined_occurrences(tokens: DataFrame, templates: DataFrame) -> DataFrame:
    """``group, source, pattern_id, template, byte_offset, entry_timestamp, variables``; the variables are taken
    against the final template."""
    t = templates.select(F.col("group").alias("g"), F.col("masked").alias("m"), F.col("template").alias("found"))
    return tokens.join(t, (F.col("group") == F.col("g")) & (F.col("masked") == F.col("m"))).select(
        "group",
        "source",
        pattern_id(F.col("group"), render(F.col("found"))).alias("pattern_id"),
        render(F.col("found")).alias("template"),
        "byte_offset",
        "entry_timestamp",
        variables(F.col("found"), F.col("tokens")).alias("variables"),
    )
