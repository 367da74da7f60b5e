"""The timestamp at the beginning of a log line, in seconds UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions.instants import EPOCH_HIGH, EPOCH_LOW, _month


def _seconds(day: Column, clock: Column) -> Column:
    """Seconds of ``yyyy-MM-dd`` and ``HH:mm:ss`` as UTC; null if invalid. Doesn't depend on the session's zone."""
    h, m, s = (F.substring(clock, p, 2).try_cast("int") for p in (1, 4, 7))
    ok = (h < 24) & (m < 60) & (s < 60)
    return F.when(ok, F.unix_date(day.try_cast("date")).cast("bigint") * 86400 + h * 3600 + m * 60 + s)


def extract_timestamp(line: Column, syslog_year: int) -> Column:
    """Seconds since 1970 of the timestamp that begins ``line``, null if there is none.

    Read are: ISO 8601 with ``T`` (an offset counts, none is UTC), with a blank (fraction after comma or dot ignored),
    ``Mon DD HH:MM:SS`` in ``syslog_year``, ``[DD/Mon/YYYY:HH:MM:SS +ZZZZ]`` whose offset is ignored, and 10-digit epochs
    of the years 2000 to 2100. The guards exclude each other, so the order is of no account.
    """
    iso = r"^(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)(?:\.\d+)?(?:(Z|z)|([+-])(\d\d):(\d\d))?"
    t = _seconds(F.regexp_extract(line, iso, 1), F.regexp_extract(line, iso, 2))
    shift = F.regexp_extract(line, iso, 5).try_cast("int") * 3600 + F.regexp_extract(line, iso, 6).try_cast("int") * 60
    with_t = t - F.when(F.regexp_extract(line, iso, 4) == "+", shift).when(
        F.regexp_extract(line, iso, 4) == "-", -shift
    ).otherwise(0)
    blank = r"^(\d{4}-\d\d-\d\d) (\d\d:\d\d:\d\d)"
    with_blank = _seconds(F.regexp_extract(line, blank, 1), F.regexp_extract(line, blank, 2))
    sys = r"^([A-Z][a-z]{2}) ([ \d]\d|\d) (\d\d:\d\d:\d\d)"
    month = F.lpad(_month(F.regexp_extract(line, sys, 1)), 2, "0")
    syslog = F.when(
        F.regexp_extract(line, sys, 1).isin("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()),
        _seconds(
            F.concat(F.lit(f"{syslog_year:04d}-"), month, F.lit("-"), F.lpad(F.trim(F.regexp_extract(line, sys, 2)), 2, "0")),
            F.regexp_extract(line, sys, 3),
        ),
    )
    clf = r"^\[?(\d\d)/([A-Z][a-z]{2})/(\d{4}):(\d\d:\d\d:\d\d) [+-]\d{4}"
    common = F.when(
        F.regexp_extract(line, clf, 2).isin("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()),
        _seconds(
            F.concat_ws(
                "-",
                F.regexp_extract(line, clf, 3),
                F.lpad(_month(F.regexp_extract(line, clf, 2)), 2, "0"),
                F.regexp_extract(line, clf, 1),
            ),
            F.regexp_extract(line, clf, 4),
        ),
    )
    number = F.regexp_extract(line, r"^(\d{10})(?!\d)", 1).try_cast("bigint")
    epoch = F.when(number.between(EPOCH_LOW, EPOCH_HIGH), number)
    return F.coalesce(
        F.when(line.rlike(iso), with_t),
        F.when(line.rlike(blank), with_blank),
        F.when(line.rlike(sys), syslog),
        F.when(line.rlike(clf), common),
        epoch,
    )
