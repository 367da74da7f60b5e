"""Column expressions that turn timestamp texts and numbers into microseconds since 1970-01-01 UTC."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.bind import bind

#: English month abbreviations in order.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

#: Seconds from 2000-01-01 to 2100-01-01, the span in which a bare number counts as an epoch; the units don't overlap.
EPOCH_LOW, EPOCH_HIGH = 946_684_800, 4_102_444_800


def epoch_unit(n: Column) -> Column:
    """``s``, ``ms``, ``us`` or ``ns`` of an epoch number; null if it is none."""
    unit = F.lit(None).cast("string")
    for name, per in (("ns", 10**9), ("us", 10**6), ("ms", 10**3), ("s", 1)):
        unit = F.when((n >= EPOCH_LOW * per) & (n < EPOCH_HIGH * per), name).otherwise(unit)
    return unit


def epoch_us(n: Column) -> Column:
    """Microseconds of an epoch number of any unit, finer digits cut; null if it is none."""
    return (
        F.when((n >= EPOCH_LOW) & (n < EPOCH_HIGH), n * 10**6)
        .when((n >= EPOCH_LOW * 10**3) & (n < EPOCH_HIGH * 10**3), n * 10**3)
        .when((n >= EPOCH_LOW * 10**6) & (n < EPOCH_HIGH * 10**6), n)
        .when((n >= EPOCH_LOW * 10**9) & (n < EPOCH_HIGH * 10**9), F.call_function("div", n, F.lit(1000)))
    )


def ntz_us(t: Column) -> Column:
    """Microseconds of a timestamp without zone as UTC, whatever the session's zone is."""
    seconds = F.unix_date(t.cast("date")).cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return seconds * 10**6 + (F.extract(F.lit("SECOND"), t) * 10**6).cast("bigint")


@cache
def zone_table() -> tuple[tuple[str, dict[str, int]], ...]:
    """Every IANA zone with the abbreviations it uses (2000 to 2040) and their offsets in seconds; about 600 rows."""
    out = []
    for name in sorted(available_timezones()):
        zone, names = ZoneInfo(name), {}
        for year in range(2040, 1999, -4):
            for month in (1, 4, 7, 10):
                at = datetime(year, month, 1, tzinfo=UTC).astimezone(zone)
                names.setdefault(at.tzname(), int(at.utcoffset().total_seconds()))
        out.append((name, names))
    return tuple(out)


def zones(spark: SparkSession, source_zones: DataFrame) -> DataFrame:
    """``zsid, zone, abbreviations`` per source; a null or unknown zone is UTC, of a repeated source the least name."""
    known = spark.createDataFrame(list(zone_table()), "known string, abbreviations map<string,int>")
    return (
        source_zones.where("log_source_id is not null")
        .groupBy(F.col("log_source_id").alias("zsid"))
        .agg(F.min("zone_name").alias("named"))
        .join(F.broadcast(known), F.col("named") == F.col("known"), "left")  # about 600 rows
        .select("zsid", F.coalesce("known", F.lit("UTC")).alias("zone"), "abbreviations")
    )


def _local_us(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, frac: Column) -> Column:
    """Microseconds of a wall-clock reading as if it were UTC; null if it is no valid reading."""
    day = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    hh, mm, ss = (F.coalesce(x.try_cast("int"), F.lit(0)) for x in (h, mi, s))
    us = F.rpad(F.substring(F.coalesce(frac, F.lit("")), 1, 6), 6, "0").try_cast("bigint")
    ok = (hh < 24) & (mm < 60) & (ss < 61)
    return F.when(
        ok, (F.unix_date(day).cast("bigint") * 86400 + hh * 3600 + mm * 60 + ss) * F.lit(10**6).cast("bigint") + us
    )


def _month(name: Column) -> Column:
    return (F.floor(F.instr(F.lit("".join(MONTHS)), F.initcap(name)) / 3) + 1).cast("string")


def _hour12(h: Column, half: Column) -> Column:
    n = F.pmod(h.try_cast("int"), F.lit(12)) + F.when(F.upper(half) == "PM", 12).otherwise(0)
    return F.when(half == "", h).otherwise(n.cast("string"))


_TIME = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?"
_ZONE = r"\s*(Z|z|[+-]\d\d:?\d\d|[A-Za-z]{2,5})?(?:\[.*)?$"

#: Layouts of a timestamp text after padding is gone, each with the places of year, month, day, hour,
#: minute, second, fraction and zone (or AM/PM) among its groups. The likeliest come first; a text has one of them.
LAYOUTS = {
    "ymd": (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})[T ]" + _TIME + _ZONE, "$1|$2|$3|$4|$5|$6|$7|$8"),
    "epoch": (r"^(\d{9,19})(?:\.(\d+))?$", "$1||||||$2|"),
    "yearless": (r"^([A-Za-z]{3}) +(\d{1,2}) " + _TIME + "$", "|$1|$2|$3|$4|$5|$6|"),
    "slashed": (r"^(\d{1,2})/(\d{1,2})/(\d{4}),? " + _TIME + r"\s*([AaPp][Mm])?$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    "clf": (r"^(\d{1,2})/([A-Za-z]{3})/(\d{4}):" + _TIME + _ZONE, "$3|$2|$1|$4|$5|$6|$7|$8"),
    "dotted": (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}) " + _TIME + _ZONE, "$3|$2|$1|$4|$5|$6|$7|$8"),
    "rfc": (r"^(?:[A-Za-z]{3}, )?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) " + _TIME + _ZONE, "$3|$2|$1|$4|$5|$6|$7|$8"),
    "compact": (r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)?(?:[.,](\d+))?" + _ZONE, "$1|$2|$3|$4|$5|$6|$7|$8"),
}


#: Layouts of readings that custom is against.
UNUSUAL = ("dotted month first", "day first with AM/PM", "other year")


def with_readings(df: DataFrame, text: str, received_us: str, zone: str, abbreviations: str) -> DataFrame:
    """``df`` with ``readings``, all valid readings of ``text`` as ``array<struct<layout, us, overlap>>``.

    Blanks, quotes and brackets around the text are ignored. ``overlap`` marks a local time that occurs twice in the
    zone; the earlier instant is given. The reading that custom favours comes first: slashed dates month first, dotted
    dates day first, and the other order where it is a date too; a yearless text in the year that puts it nearest to
    ``received_us``, then in the two beside; it has no reading without that. Readings which custom is against carry a
    layout of ``UNUSUAL``; of a slashed date without AM/PM none is. Readings of the same instant count once. The array is
    empty where the text gives no instant. Each row costs one regular expression per layout tried and one more.
    """
    kind = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(LAYOUTS.items()):
        kind = F.when(F.col("_s").rlike(pattern), name).otherwise(kind)
    parts = F.lit(None).cast("string")
    for name, (pattern, places) in reversed(LAYOUTS.items()):
        parts = F.when(F.col("_k") == name, F.regexp_replace("_s", pattern, places)).otherwise(parts)
    staged = bind(df, _s=F.regexp_replace(text, r"""^[\s'"`(\[{<]+|[\s'"`)\]}>]+$""", ""))
    staged = bind(bind(staged, _k=kind), _p=F.split(parts, r"\|"))
    y, mo, d, h, mi, s, frac, z = (F.col("_p")[i] for i in range(8))
    k, got, at = F.col("_k"), F.col(received_us), F.col(zone)

    def to_utc(local: Column) -> Column:
        return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), at))

    month = F.when(mo.rlike("^[A-Za-z]"), _month(mo)).otherwise(mo)
    hour = F.when(k == "slashed", _hour12(h, z)).otherwise(h)
    clock = (hour, mi, s, frac)
    dated = k.isin("ymd", "slashed", "clf", "dotted", "rfc", "compact")
    received = F.timestamp_micros(got)
    number = y.try_cast("decimal(20,0)").cast("bigint")
    epoch = F.when(
        (frac != "") & (epoch_unit(number) == "s"),
        number * 10**6 + F.rpad(F.substring(frac, 1, 6), 6, "0").try_cast("bigint"),
    ).otherwise(epoch_us(number))
    zoned = F.when(k == "slashed", "").otherwise(z)
    sign = F.when(F.substring(zoned, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(zoned, "[^0-9]", "")
    fixed = sign * (F.substring(digits, 1, 2).try_cast("bigint") * 3600 + F.substring(digits, 3, 2).try_cast("bigint") * 60)
    named = F.when(F.upper(zoned).isin("Z", "UTC", "GMT"), F.lit(0)).otherwise(F.try_element_at(abbreviations, zoned))
    offset = F.when(zoned.rlike("^[+-]"), fixed).otherwise(named.cast("bigint"))

    staged = bind(
        staged,
        _local=F.when(dated, _local_us(y, month, d, *clock)),
        _swapped=F.when(k.isin("slashed", "dotted") & (mo != d), _local_us(y, d, mo, *clock)),
        _epoch=F.when(k == "epoch", epoch),
        _zoned=zoned,
        _offset=offset,
        _years=F.when(k == "yearless", F.array(*(_local_us((F.year(received) + i).cast("string"), month, d, *clock) for i in (-1, 0, 1)))),
    )
    zoned, offset = F.col("_zoned"), F.col("_offset")

    def placed(local: Column) -> Column:
        return F.when(zoned == "", to_utc(local)).otherwise(local - offset * 10**6)

    hour_us = 3_600_000_000

    def twice(local: Column) -> Column:
        # a clock set back: an hour later on the clock is more than an hour later in time
        return (zoned == "") & (to_utc(local + hour_us) - to_utc(local) > hour_us)

    def reading(name: Column, us: Column, overlap: Column) -> Column:
        return F.when(us.isNotNull(), F.struct(name.alias("layout"), us.alias("us"), overlap.alias("overlap")))

    local, swapped = F.col("_local"), F.col("_swapped")
    custom = F.when(k == "slashed", "month first").otherwise(k)
    other = F.when(k == "dotted", "dotted month first").when(z == "", "day first").otherwise("day first with AM/PM")
    # the nearest year first; an empty zone stands for the source's
    wall = F.filter("_years", lambda x: x.isNotNull())
    by_year = F.array_sort(F.transform(wall, lambda x: F.struct(F.abs(to_utc(x) - got).alias("far"), to_utc(x).alias("us"), twice(x).alias("overlap"))))
    readings = (
        F.when(dated, F.array(
            reading(custom, placed(local), twice(local)),
            reading(other, placed(swapped), twice(swapped)),
        ))
        .when(k == "yearless", F.transform(by_year, lambda x, i: reading(
            F.when(i == 0, "yearless").otherwise("other year"), F.when(x["far"].isNotNull(), x["us"]), x["overlap"])))
        .when(k == "epoch", F.array(reading(k, F.col("_epoch"), F.lit(False))))
    )
    helpers = ["_s", "_k", "_p", "_local", "_swapped", "_years", "_epoch", "_zoned", "_offset"]
    return staged.withColumn("readings", F.array_compact(F.coalesce(readings, F.array().cast("array<struct<layout:string,us:bigint,overlap:boolean>>")))).drop(*helpers)
