"""Near-duplicate templates: the same structure, or nearly the same characteristic tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.tokens import WILDCARD, similarity, tokenize
from strataloom.operators.graph import components
from strataloom.session import cut


def template_tokens(patterns: DataFrame, key: str = "id", group: str = "file_group_id", template: str = "template") -> DataFrame:
    """``id, group, tokens``. Line breaks count as blanks here. Patterns without tokens are left out."""
    return patterns.select(
        F.col(key).alias("id"), F.col(group).alias("group"), tokenize(F.regexp_replace(template, "\n", " ")).alias("tokens")
    ).where(F.size("tokens") > 0)


def structural_pairs(tokens: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``a, b, similarity`` of the pairs of one group and token count with at least ``threshold`` of their positions alike.

    Candidates: at most m positions may differ, so of m + 1 segments of the positions that no template of the block
    leaves open, one agrees; templates are joined on each segment, never block by block. Blocks with fewer such positions
    than segments are cut by the wildcards themselves, see ``_loose_pairs``.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    t = tokens.withColumn("size", F.size("tokens")).withColumn(
        "slack", F.floor(F.lit(1.0 + 1e-9) * F.col("size") * (1 - threshold) + 1e-9).cast("int")
    )
    wild = (
        t.select("group", "size", F.posexplode("tokens").alias("at", "token"))
        .groupBy("group", "size", "at")
        .agg(F.max(F.col("token") == WILDCARD).alias("wild"))
        .where("not wild")
        .groupBy(F.col("group").alias("g"), F.col("size").alias("s"))
        .agg(F.array_sort(F.collect_list("at")).alias("firm"))  # at most a template's tokens
    )
    placed = t.join(wild, F.col("group").eqNullSafe(F.col("g")) & (F.col("size") == F.col("s")), "left").withColumn(
        "firm", F.coalesce("firm", F.array().cast("array<int>"))
    )
    placed = cut(placed)
    enough = F.size("firm") > F.col("slack")
    keyed = placed.where(enough).withColumn("parts", F.col("slack") + 1).withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    segment_text = F.array_join(
        F.transform(
            F.filter("firm", lambda p, i: F.pmod(i, F.col("parts")) == F.col("segment")),
            lambda p: F.get(F.col("tokens"), p),
        ),
        " ",
    )
    blocks = keyed.withColumn("key", segment_text)
    left = blocks.select("group", "size", "segment", "key", F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = blocks.select("group", "size", "segment", "key", F.col("id").alias("b"), F.col("tokens").alias("tb"))
    on = left["group"].eqNullSafe(right["group"]) & (left["size"] == right["size"]) & (left["segment"] == right["segment"]) & (left["key"] == right["key"])
    near = left.join(right, on & (F.col("a") < F.col("b"))).select("a", "b", "ta", "tb").unionByName(_loose_pairs(placed.where(~enough)))
    return (
        near.withColumn("similarity", similarity(F.col("ta"), F.col("tb")))
        .where(F.col("similarity") >= threshold)
        .select("a", "b", "similarity")
        .distinct()
    )


def _loose_pairs(placed: DataFrame) -> DataFrame:
    """``a, b, ta, tb``: candidates among templates that have a wildcard at most positions of their block, so that no
    position is firm for all.

    Templates of one block that have their wildcards at the same places form a kind; kinds of a block are few beside
    templates. For two kinds the positions at which both hold a word are firm, and of slack + 1 segments of those one
    agrees. Two kinds with no more firm positions than slack have all their templates as candidates, each of the one
    against each of the other, in as many tasks as the first has templates.
    """
    wild = F.transform("tokens", lambda t: t == WILDCARD)
    t = placed.select("id", "group", "size", "slack", "tokens", F.xxhash64(wild).alias("kind"), wild.alias("wild"))
    kinds = t.groupBy("group", "size", "kind").agg(F.first("wild").alias("wild"), F.first("slack").alias("slack"))
    other = kinds.select(F.col("group").alias("g2"), F.col("size").alias("s2"), F.col("kind").alias("k2"), F.col("wild").alias("w2"))
    both = F.zip_with("wild", "w2", lambda x, y: ~x & ~y)
    met = (
        kinds.join(other, F.col("group").eqNullSafe(F.col("g2")) & (F.col("size") == F.col("s2")) & (F.col("kind") <= F.col("k2")))
        .withColumn("firm", F.filter(F.transform(both, lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))
        .withColumn("parts", F.when(F.size("firm") > F.col("slack"), F.col("slack") + 1).otherwise(1))
        .select(F.col("group").alias("mg"), F.col("size").alias("ms"), F.col("kind").alias("m1"), F.col("k2").alias("m2"), "firm", "parts", (F.size("firm") > F.col("slack")).alias("cut"))
    )
    here = F.col("group").eqNullSafe(F.col("mg")) & (F.col("size") == F.col("ms"))

    def side(which: str, name: str) -> DataFrame:
        keyed = t.join(met, here & (F.col("kind") == F.col(which))).withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        words = F.transform(F.filter("firm", lambda p, i: F.pmod(i, F.col("parts")) == F.col("segment")), lambda p: F.get(F.col("tokens"), p))
        key = F.when(F.col("cut"), F.xxhash64(words)).otherwise(0)
        return keyed.select(
            F.col("mg").alias(f"g{name}"), F.col("ms").alias(f"s{name}"), F.col("m1").alias(f"p{name}"), F.col("m2").alias(f"q{name}"),
            F.col("segment").alias(f"n{name}"), key.alias(f"k{name}"), F.col("id").alias(name), F.col("tokens").alias(f"t{name}"),
        )

    x, y = side("m1", "x"), side("m2", "y")
    on = F.col("gx").eqNullSafe(F.col("gy"))
    for c in "spqnk":
        on = on & (F.col(f"{c}x") == F.col(f"{c}y"))
    swap = F.col("x") < F.col("y")
    return (
        x.join(y, on & (F.col("x") != F.col("y")))
        .select(
            F.when(swap, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(swap, F.col("y")).otherwise(F.col("x")).alias("b"),
            F.when(swap, F.col("tx")).otherwise(F.col("ty")).alias("ta"), F.when(swap, F.col("ty")).otherwise(F.col("tx")).alias("tb"),
        )
    )


def idf(tokens: DataFrame) -> DataFrame:
    """``group, token, idf``: ln(N / n), a tenth of it for tokens in more than 80 % of a group's templates."""
    n = tokens.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("n_templates"))
    df = (
        tokens.select("group", F.explode(F.array_distinct("tokens")).alias("token"))
        .where(~F.col("token").isin(WILDCARD, "\n"))
        .groupBy("group", "token")
        .agg(F.count("*").alias("df"))
    )
    weight = F.ln(F.col("n_templates") / F.col("df"))
    return df.join(n, F.col("group").eqNullSafe(F.col("g"))).select(
        "group", "token", "df", F.when(F.col("df") / F.col("n_templates") > 0.8, weight * 0.1).otherwise(weight).alias("idf")
    )


def semantic_pairs(tokens: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``a, b, similarity`` of the pairs of one group whose TF-IDF vectors have a cosine of at least ``threshold``.

    Candidates share one of each other's leading tokens, rarest first, up to where the rest of a unit vector is shorter
    than the threshold; what no leading token links can't reach it. Vectors of weight 0 are like nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    weights = idf(tokens)
    uses = (
        tokens.select("id", "group", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
        .where(~F.col("token").isin(WILDCARD, "\n"))
        .groupBy("id", "group", "size", "token")
        .agg(F.count("*").alias("uses"))
    )
    w = weights.select(F.col("group").alias("g"), F.col("token").alias("t"), "df", "idf")
    vector = (
        uses.join(w, F.col("group").eqNullSafe(F.col("g")) & (F.col("token") == F.col("t")))
        .withColumn("weight", F.col("uses") / F.col("size") * F.col("idf"))
        .where("weight > 0")
    )
    own = W.partitionBy("id")
    unit = vector.withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(own)))
    rest = F.sum(F.col("weight") * F.col("weight")).over(own.orderBy("df", "token").rowsBetween(0, W.unboundedFollowing))
    lead = unit.withColumn("rest", F.sqrt(rest)).where(F.col("rest") >= threshold - 1e-9)
    left = lead.select("group", "token", F.col("id").alias("a"))
    right = lead.select("group", "token", F.col("id").alias("b"))
    near = (
        left.join(right, left["group"].eqNullSafe(right["group"]) & (left["token"] == right["token"]) & (F.col("a") < F.col("b")))
        .select("a", "b")
        .distinct()
    )
    va = unit.select(F.col("id").alias("ia"), F.col("token").alias("ta"), F.col("weight").alias("wa"))
    vb = unit.select(F.col("id").alias("ib"), F.col("token").alias("tb"), F.col("weight").alias("wb"))
    return (
        near.join(va, F.col("a") == F.col("ia"))
        .join(vb, (F.col("b") == F.col("ib")) & (F.col("ta") == F.col("tb")))
        .groupBy("a", "b")
        .agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
        .where(F.col("similarity") >= threshold - 1e-9)
    )


def duplicate_classes(patterns: DataFrame, mode: str = "structural", threshold: float = 0.95, most_per_group: int | None = None) -> DataFrame:
    """``id, component, n_links`` of every pattern that has a near-duplicate; the component is its least id.

    ``most_per_group`` (off by default) keeps the most frequent patterns of each group only.
    """
    if most_per_group is not None:
        w = W.partitionBy("file_group_id").orderBy(F.desc("occurrence_count"), "id")
        patterns = patterns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most_per_group).drop("_r")
    tokens = template_tokens(patterns)
    pairs = (structural_pairs if mode == "structural" else semantic_pairs)(tokens, threshold).select("a", "b")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("e")).groupBy("e").agg(F.count("*").alias("n_links"))
    found = components(ends.select(F.col("e").alias("id")), pairs)
    return found.join(ends, F.col("id") == F.col("e")).select("id", "component", "n_links")
