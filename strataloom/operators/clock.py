"""One UTC instant for timestamps of mixed layouts, precisions and zones.

Method: expectation-maximisation over a mixture of layouts per source. Every value is read under each layout in which it
is valid; a reading's likelihood is the weight of its layout in the source times that of its delay before reception.
The posterior chooses among several readings; what stays undecided is marked. A value with a single reading needs no
choice and only feeds the mixture. Custom (dotted dates day first, AM/PM month first, the nearest year) is a prior of
99 to 1, which a source's own values can outweigh.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.instants import UNUSUAL, epoch_unit, epoch_us, ntz_us, with_readings, zones
from strataloom.session import cut, ship, small

#: Upper bounds, in seconds, of the classes of delay between an instant and its reception.
DELAYS = (-86_400, -3_600, -60, 0, 60, 3_600, 86_400, 30 * 86_400)
ROUNDS, SURE = 50, 0.9
#: Prior of a reading that custom is against, to one that it favours.
AGAINST_CUSTOM = 0.01


def _delay_class(seconds: Column) -> Column:
    out = F.lit(len(DELAYS))
    for i in reversed(range(len(DELAYS))):
        out = F.when(seconds <= DELAYS[i], i).otherwise(out)
    return F.coalesce(out, F.lit(-1))


def fit_mixture(signatures: pd.DataFrame) -> pd.DataFrame:
    """EM over one source. ``signatures``: ``source, signature, n``; a signature lists ``layout@delay class``.

    Returns the ambiguous ones with the index of the likeliest reading and its posterior.
    """
    options = [[o.rsplit("@", 1) for o in s.split("|")] for s in signatures["signature"]]
    counts = signatures["n"].to_numpy(float)
    layouts = sorted({a for o in options for a, _ in o})
    delays = sorted({b for o in options for _, b in o})
    weight = dict.fromkeys(layouts, 1 / len(layouts))
    delay = dict.fromkeys(delays, 1 / len(delays))
    posteriors: list[list[float]] = []
    for _ in range(ROUNDS):
        posteriors = []
        w, d = dict.fromkeys(layouts, 0.5), dict.fromkeys(delays, 0.5)
        for o, n in zip(options, counts, strict=True):
            p = [weight[a] * delay[b] * (AGAINST_CUSTOM if a in UNUSUAL else 1.0) for a, b in o]
            total = sum(p) or 1.0
            posteriors.append([x / total for x in p])
            for (a, b), x in zip(o, posteriors[-1], strict=True):
                w[a] += n * x
                d[b] += n * x
        ws, ds = sum(w.values()), sum(d.values())
        new = {k: v / ws for k, v in w.items()}
        moved = max(abs(new[k] - weight[k]) for k in layouts)
        weight, delay = new, {k: v / ds for k, v in d.items()}
        if moved < 1e-6:
            break
    rows = [
        (src, sig, max(range(len(p)), key=lambda i: (p[i], -i)), max(p))
        for src, sig, p in zip(signatures["source"], signatures["signature"], posteriors, strict=True)
        if len(p) > 1
    ]
    return pd.DataFrame(rows, columns=["em_source", "em_signature", "pick", "posterior"])


def text_instants(
    df: DataFrame, row_id: str, source: str, text: str, received: str, source_zones: DataFrame, spark: SparkSession
) -> DataFrame:
    """``id, utc_us, layout, posterior, ambiguous``: every row whose ``text`` gives an instant, repeated rows too.

    ``ambiguous`` marks a choice among layouts below a posterior of 0.9, and local times that the clock went through
    twice (of these the earlier is given). Null, empty and unreadable texts give no row. A null source, zone or
    reception is allowed: the zone is then UTC, the delay unknown. Ties go to the reading listed first, which is the one
    that custom favours.
    """
    ship(spark)
    got = F.unix_micros(received) if dict(df.dtypes)[received] == "timestamp" else ntz_us(F.col(received))
    slim = df.select(
        F.col(row_id).alias("id"),
        F.col(source).alias("source"),
        F.col(text).alias("text"),
        got.alias("received"),
    ).where("text is not null")
    # sent to all tasks if small; else a plain table, against which AQE can split a source with many rows
    at = small(cut(zones(spark, source_zones)))
    zoned = slim.join(at, F.col("source") == F.col("zsid"), "left").withColumn("zone", F.coalesce("zone", F.lit("UTC")))
    read = (
        with_readings(zoned, "text", "received", "zone", "abbreviations")
        .where(F.size("readings") > 0)
        .select("id", "source", "received", F.col("readings").alias("c"))
    )
    signed = read.withColumn(
        "signature",
        F.array_join(
            F.transform(
                "c",
                lambda x: F.concat(
                    x["layout"], F.lit("@"), _delay_class((F.col("received") - x["us"]) / 10**6).cast("string")
                ),
            ),
            "|",
        ),
    )
    # written once: the texts are matched once only, for the fit and for the choice
    signed = cut(signed.select("id", "source", "signature", "c"))
    one = signed.where(F.size("c") == 1).select(
        "id",
        F.col("c")[0]["us"].alias("utc_us"),
        F.col("c")[0]["layout"].alias("layout"),
        F.lit(1.0).alias("posterior"),
        F.col("c")[0]["overlap"].alias("ambiguous"),
    )
    # a source has at most a few hundred signatures, whatever its number of rows
    fitted = (
        signed.groupBy("source", "signature")
        .agg(F.count("*").alias("n"))
        .groupBy("source")
        .applyInPandas(fit_mixture, "em_source bigint, em_signature string, pick int, posterior double")
    )
    many = (
        signed.where(F.size("c") > 1)
        .join(small(cut(fitted)), F.col("source").eqNullSafe(F.col("em_source")) & (F.col("signature") == F.col("em_signature")))
        .withColumn("x", F.expr("c[pick]"))
        .select(
            "id",
            F.col("x.us").alias("utc_us"),
            F.col("x.layout").alias("layout"),
            "posterior",
            (F.col("x.overlap") | (F.col("posterior") < SURE)).alias("ambiguous"),
        )
    )
    return one.unionByName(many)


def number_instants(df: DataFrame, row_id: str, number: str) -> DataFrame:
    """As ``text_instants`` for epoch numbers: the layout is the unit; the units' spans are disjoint, so each number
    has one reading. Null and numbers that are no epoch (0, -1) give no row."""
    n = F.col(number)
    return df.select(
        F.col(row_id).alias("id"),
        epoch_us(n).alias("utc_us"),
        epoch_unit(n).alias("layout"),
        F.lit(1.0).alias("posterior"),
        F.lit(False).alias("ambiguous"),
    ).where("utc_us is not null")
