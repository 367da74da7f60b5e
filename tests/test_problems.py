"""The general data-preparation operators: against brute force, and on odd input."""

import random
from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from strataloom.functions.grammar import LEVELS, Grammar, HeaderParser
from strataloom.operators import balanced, clock, entries, incremental
from strataloom.session import scratch


# 2 -------------------------------------------------------------------------------------------------------------------


def brute_profile(rows):
    out = {}
    for key in {k for _, k, _ in rows}:
        mine = sorted((i, t) for i, k, t in rows if k == key)
        times = [t for _, t in mine if t is not None]
        steps = [b - a for a, b in zip(times, times[1:])]
        out[key] = (
            len(mine), len(times), times[0] if times else None, times[-1] if times else None,
            sum(s < 0 for s in steps), max(steps) if steps else None,
        )
    return out


def test_profile_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice([1, 1, 1, 1, 2, 3, None]), r.choice([None, r.randrange(10**6)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, key bigint, t bigint").withColumns(
        {c: F.lit("x") for c in ("k", "_range", "_no", "chunk", "n_rows")}  # names that the operator uses itself
    )
    got = balanced.per_key_profile(df, "key", ["id"], F.col("t"), min_chunk=100, ranges=7).collect()
    assert {g["key"]: (g["n_rows"], g["n_timed"], g["first_us"], g["last_us"], g["steps_back"], g["longest_step_us"]) for g in got} == brute_profile(rows)
    assert max(g["largest_chunk"] for g in got) <= 100
    assert sum(g["n_chunks"] for g in got) > len(got)


def test_numbers_are_exact(spark):
    df = spark.createDataFrame([(i % 17, i % 3) for i in range(500)], "o int, key int")  # ties everywhere
    got = balanced.number_by_key(df, "key", ["o"], 5).groupBy("key").agg(F.collect_list("_no").alias("n"), F.max("_n").alias("c"))
    for g in got.collect():
        assert sorted(g["n"]) == list(range(g["c"]))


@pytest.mark.parametrize("ranges", [7, 300])
def test_numbers_follow_the_order(spark, ranges):
    r = random.Random(6)
    rows = [(r.choice([1, 1, 2]), r.choice([None, r.randrange(10**6)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "key int, o bigint, tie int")
    got = {x["tie"]: x["_no"] for x in balanced.number_by_key(df, "key", ["o", "tie"], ranges).collect()}
    for key in (1, 2):
        mine = sorted((o is not None, o or 0, t) for k, o, t in rows if k == key)  # nulls first
        assert [got[t] for _, _, t in mine] == list(range(len(mine)))


def test_profile_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, key bigint, t bigint")
    assert balanced.per_key_profile(df, "key", ["id"], F.col("t")).count() == 0


# 3 -------------------------------------------------------------------------------------------------------------------


def changed(spark, raw, sources, scans):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = incremental.entries_to_process(
        spark,
        df(raw, "log_source_id bigint, byte_offset bigint, raw_message string, block string, _part string"),
        df(sources, "id bigint, last_processed_position bigint, file_hash string"),
        df(scans, "scan_id bigint, log_source_id bigint, scanned_at timestamp_ntz, status string, file_size bigint, file_hash string"),
        scratch(spark, "test"),
        parts=8,
    )
    return sorted(tuple(r) for r in found.collect())


def test_changed_entries(spark):
    at = lambda d: datetime(2026, 1, d)
    raw = [(s, o, "m", "x", "y") for s in range(1, 8) for o in (0, 10, 20)]
    raw += [(1, 20, "m", "x", "y"), (2, 20, None, "x", "y"), (None, 1, "", "", ""), (1, None, "", "", "")]
    sources = [(1, 15, "AB"), (2, 15, "md5:ab"), (3, 15, "zz"), (4, 50, None), (5, None, None), (6, 15, None)]
    scans = [
        (1, 1, at(1), "complete", 30, "sha:ab"),  # same hash, spelled otherwise
        (2, 2, at(1), "complete", 30, "cd"),  # older than the next
        (3, 2, at(2), "complete", 30, "AB"),
        (4, 2, at(3), "failed", 0, None),
        (5, 3, at(1), "complete", 30, "yy"),  # changed
        (6, 4, at(1), "complete", 30, None),  # shorter than the position
        (7, 5, at(1), "complete", 30, "q"),  # nothing known of it
        (8, 6, at(1), "failed", 30, None),  # never scanned well
        (9, 7, at(1), "complete", None, None),  # a source that is not listed
    ]
    want = [(1, 20), (2, 20)] + [(s, o) for s in (3, 4, 5, 7) for o in (0, 10, 20)]
    assert changed(spark, raw, sources, scans) == sorted(want)
    assert changed(spark, [], [], []) == []


def test_incremental_table(spark, tmp_path):
    t = incremental.IncrementalTable(spark, str(tmp_path / "t"), ["k"], 8)
    schema = "k bigint, twice bigint, _part int"
    double = lambda d: d.select("k", (F.col("v") * 2).alias("twice"), "_part")
    make = lambda rows: spark.createDataFrame(rows, "k bigint, v bigint")
    read = lambda: sorted((r["k"], r["twice"]) for r in t.read(schema).collect())
    first = [(i, i) for i in range(50)]
    assert len(t.run(make(first), double)) == 8
    assert read() == [(i, 2 * i) for i in range(50)]
    assert t.run(make(list(reversed(first))), double) == []  # order doesn't matter
    second = [(i, i + (i == 7)) for i in range(50)]
    assert len(t.run(make(second), double)) == 1
    assert read() == [(i, 2 * (i + (i == 7))) for i in range(50)]

    def broken(d):
        raise RuntimeError("lost")

    third = [*second, (99, 1)]
    with pytest.raises(RuntimeError):
        t.run(make(third), broken)
    assert read() == [(i, 2 * (i + (i == 7))) for i in range(50)]
    assert len(t.run(make(third), double)) == 1  # done again
    assert (99, 2) in read()
    assert t.run(make([(1, 1)]), double)
    assert read() == [(1, 2)]  # partitions that vanished are gone


def pending(spark, path, rows, position, hash_=None):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    return incremental.PendingEntries(
        spark,
        df([(1, o, t) for o, t in rows], "log_source_id bigint, byte_offset bigint, raw_message string"),
        df([(1, position, "ab")], "id bigint, last_processed_position bigint, file_hash string"),
        df([(1, 1, datetime(2026, 1, 1), "complete", 99, hash_)], "scan_id bigint, log_source_id bigint, scanned_at timestamp_ntz, status string, file_size bigint, file_hash string"),
        path,
        parts=4,
    )


def test_runs_in_a_row(spark):
    path = scratch(spark, "rows")
    offsets = lambda p: sorted(r["byte_offset"] for r in p.rows.collect())
    rows = [(0, "a"), (10, "b")]
    first = pending(spark, path, rows, 0)
    assert offsets(first) == [0, 10]
    assert offsets(pending(spark, path, rows, 0)) == [0, 10]  # not committed: the same again
    first.commit()
    assert offsets(pending(spark, path, rows, 20)) == []  # the position went on, nothing is new
    pending(spark, path, rows, 20).commit()
    more = [*rows, (20, "c"), (30, None)]
    grown = pending(spark, path, more, 20)
    assert offsets(grown) == [20, 30]
    assert offsets(pending(spark, path, list(reversed(more)), 20)) == [20, 30]  # failed before the commit
    grown.commit()
    settled = pending(spark, path, more, 40)
    assert offsets(settled) == []
    settled.commit()
    edited = [(0, "a"), (10, "B"), *more[2:]]
    found = pending(spark, path, edited, 40)
    assert offsets(found) == [10]  # changed in place
    assert offsets(pending(spark, path, edited, 40)) == [10]
    found.commit()
    quiet = pending(spark, path, edited, 40)
    assert offsets(quiet) == []
    quiet.commit()
    assert offsets(pending(spark, path, edited, 40, "cd")) == [0, 10, 20, 30]  # another file under the name
    assert offsets(pending(spark, path, [], 40)) == []  # every partition vanished


def test_partition_that_comes_out_empty(spark, tmp_path):
    t = incremental.IncrementalTable(spark, str(tmp_path / "t"), ["k"], 1)
    keep = lambda d: d.where("v > 0").select("k", "_part")
    make = lambda rows: spark.createDataFrame(rows, "k bigint, v bigint")
    t.run(make([(1, 1), (2, 1)]), keep)
    assert sorted(r["k"] for r in t.read("k bigint, _part int").collect()) == [1, 2]
    assert t.run(make([(1, 0), (2, 0)]), keep) == [0]
    assert t.read("k bigint, _part int").count() == 0


def test_failure_between_data_and_state(spark, tmp_path):
    t = incremental.IncrementalTable(spark, str(tmp_path / "t"), ["k"], 2)
    copy = lambda d: d.select("k", "v", "_part")
    make = lambda rows: spark.createDataFrame(rows, "k bigint, v bigint")
    read = lambda: sorted((r["k"], r["v"]) for r in t.read("k bigint, v bigint, _part int").collect())
    t.run(make([(i, 0) for i in range(9)]), copy)
    t.prepare(make([(i, 1) for i in range(9)]), copy)  # and then the run is lost
    assert set(read()) <= {(i, 0) for i in range(9)}  # nothing of a run that isn't committed
    t.run(make([(i, 1) for i in range(9)]), copy)
    assert read() == [(i, 1) for i in range(9)]


# 5 -------------------------------------------------------------------------------------------------------------------

ROWS = [
    ("2025-12-25 13:45:18,617 *INFO* [Work Lane 6] com.a.B - hello [x] 1", "INFO", "com.a.B", "hello [x] 1"),
    ("[2025-12-28T14:43:29.02+05:30][info    ][a.B] m", "INFO", "a.B", "m"),
    ("[2025-12-28 17:19:21,878] [a_sync] [WARNING] m", "WARN", "a_sync", "m"),
    ("[01/Nov/2025:08:06:30 -0400] c-worker FINEST: m: n", "TRACE", "c-worker", "m: n"),
    ("a.B (11/01/2025 02:46:19 PM) err >> m", "ERROR", "a.B", "m"),
    ("a.B (2025-11-01 13:44:48 EDT) notice >> m", "INFO", "a.B", "m"),
    ("SEVERE; 07.03.2026 16:44:22; a.B; m; n", "ERROR", "a.B", "m; n"),
    ("warn; Tue, 16 Dec 2025 22:32:43 -0500; a.io; m", "WARN", "a.io", "m"),
    ("Mar  8 04:03:03 node-1 a.B[13960]: <debug> ERROR m", "DEBUG", "a.B", "ERROR m"),
    ("Mar 08 04:03:03 node-1 a.B[13960]: [TRACE] m", "TRACE", "a.B", "m"),
    ("Jan 21 17:10:13 node-x a.B[1]: err: m", "ERROR", "a.B", "m"),
    ("I0401 12:23:26.186008 25301 a.B:527] m", "INFO", "a.B", "m"),
    ("2025-11-02T04:25:13.29+00:00 | warning | a.B | m", "WARN", "a.B", "m"),
    ("2026-04-05 05:20:07,308|trace|a.B|m|n", "TRACE", "a.B", "m|n"),
    ("1763397029.354 F a.B: m", "FATAL", "a.B", "m"),
    ('{"time": 1761424388478, "lvl": 40, "logger": "aSvc", "ctx": {"level": 1, "x": [1, {}]}, "msg": "m \\"q\\""}', "WARN", "aSvc", 'm "q"'),
    ('{\r\n  "@ts": "x",\r\n  "level": "crit",\r\n  "component": "a"\r\n}', "FATAL", "a", ""),
    ('message="m \\"n\\"" ts="2025-12-18T10:15:07Z" severity=error pid=3 logger=a.io', "ERROR", "a.io", 'm "n"'),
]


@pytest.mark.parametrize(("text", "level", "component", "message"), ROWS)
def test_headers(text, level, component, message):
    got = HeaderParser()(text)
    assert (got["level"], got["component"], got["message"]) == (level, component, message)


OTHER_ROWS = [
    ("2025-12-25 13:45:18,617 INFO com.x - hello", "INFO", "com.x", "hello"),
    ("2025-12-25 13:45:18,617 [main] INFO com.x.Y - hello", "INFO", "com.x.Y", "hello"),
    ("2025-12-25 13:45:18.617 DEBUG [http-nio-8080-exec-1] com.x.Y: hello", "DEBUG", "com.x.Y", "hello"),
    ("2025-12-25 13:45:18,617 - mod.name - WARNING - a - b", "WARN", "mod.name", "a - b"),
    ("2025-12-25 13:45:18.617  INFO 12345 --- [           main] c.e.Demo          : hello", "INFO", "c.e.Demo", "hello"),
    ("25-Dec-2025 13:45:18.617 INFO [main] org.x.X - hi", "INFO", "org.x.X", "hi"),
    ("[ERROR] 2026-01-01 10:00:00 [main] com.x - m", "ERROR", "com.x", "m"),
    ("2026-01-15 08:00:05.005 *ERROR* [pool-thread-5] com.app.Service - Operation completed in 35ms for request-5", "ERROR", "com.app.Service", "Operation completed in 35ms for request-5"),
    ("2026-01-15 08:00:20.020 *WARN* [scheduler-0] com.app.Retry - Retry attempt 2 for task-20", "WARN", "com.app.Retry", "Retry attempt 2 for task-20"),
    ("2026-01-15T08:00:05Z ERROR [worker 3] com.app: x", "ERROR", "com.app", "x"),
    ("2025-12-25 13:45:18,617 [com.x] INFO: hello", "INFO", "com.x", "hello"),
    ("Jan 21 17:10:13 node-x cron: ERROR: m", "ERROR", "cron", "m"),
    ("2025-12-25 13:45:18 | INFO | mod.fn:42 - hello", "INFO", "mod.fn", "hello"),
    ("2025-12-25 13:45:18,617 INFO com.x - hello\nsecond", "INFO", "com.x", "hello\nsecond"),
]


@pytest.mark.parametrize(("text", "level", "component", "message"), OTHER_ROWS)
def test_headers_of_parts(text, level, component, message):
    got = HeaderParser()(text)
    assert (got["level"], got["component"], got["message"]) == (level, component, message)


def test_headers_without_component():
    text = "2026/01/15 08:00:00 [error] 1234#5678: *90 connect() failed"
    got = HeaderParser(Grammar(needed=("ts", "lv")))(text)
    assert (got["ts"], got["level"], got["component"], got["message"]) == ("2026/01/15 08:00:00", "ERROR", None, "*90 connect() failed")
    assert HeaderParser()(text) is None


def test_message_length_is_kept():
    long = "x" * 300_000
    assert HeaderParser()("2025-12-25 13:45:18,617 INFO com.x - " + long)["message"] == long


@pytest.mark.parametrize(
    "text",
    [None, "", "2025-12-25 13:45:18,617 ERROR in x", "13:00 INFO x - m", "INFO x - m", "\tat a.B(C.java:1)", "  last ERROR at 2026-02-16 06:12:44 in x", "Caused by: x", "---", "{", '{"level": "INFO"}', "x=1 y=2", "ERROR only"],
)
def test_no_header(text):
    assert HeaderParser()(text) is None


@pytest.mark.parametrize("first", ["a = b", "x = 1 y", "[ = ]", "token=abc== x=1", "k==v", "{=", "= $ ="])
def test_equals_signs_leave_other_shapes_alone(first):
    parse = HeaderParser()
    assert parse(first) is None and parse(first + " =") is None
    for text, level, component, message in ROWS:
        got = parse(text)
        assert (got["level"], got["component"], got["message"]) == (level, component, message)
    for text in ("a b = c", "a c d e f", "x = 1 y", "[ x ]", "k=v k=w k=z", "token=abc== x=2", "{ x"):
        assert parse(text) is None


def test_dollar_sign_is_no_end_of_a_row():
    parse, text = HeaderParser(), '{"ts": 1, "level": "info", "logger": "a"}'
    assert parse(text)["component"] == "a" and parse(text + "$") is None


def test_levels_are_known():
    assert {"TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"} == set(LEVELS.values())


def test_long_texts_parse_in_reasonable_time():
    many = "{" + ", ".join(f'"k{i}": {i}' for i in range(20_000)) + ', "ts": 1, "level": "info", "logger": "a"}'
    assert HeaderParser()(many)["component"] == "a"
    assert HeaderParser()("2026-04-05 05:20:07|info|a|" + "x [( " * 200_000)["component"] == "a"


@pytest.mark.parametrize("words", [5, 19, 36, 400])
def test_long_thread_names(words):
    thread = " ".join(["Lane"] * words)
    got = HeaderParser()(f"2025-12-25 13:45:18,617 *INFO* [{thread}] a.B - m")
    assert (got["level"], got["component"], got["message"]) == ("INFO", "a.B", "m")


def raw(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, log_source_id bigint, byte_offset bigint, raw_message string")
    return df.withColumns({c: F.lit(1) for c in ("source", "offset", "first", "head", "seam", "place", "level")})


def brute_entries(rows):
    out, parse, seen = [], HeaderParser(), {}
    for i, s, o, m in rows:
        if s is None or o is None:
            continue
        if (s, o) not in seen or (seen[s, o][1] is None, seen[s, o][0]) > (m is None, i):
            seen[s, o] = (i, m)
    for (s, o), (_, m) in sorted(seen.items()):
        f = parse(m)
        if f:
            out.append([s, o, o, f["level"], f["component"], f["message"]])
        elif out and out[-1][0] == s:
            out[-1][2] = o
            out[-1][5] += "\n" + (m or "")
    return sorted(map(tuple, out))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_entries_equal_brute_force(spark, adaptive):
    r = random.Random(3)
    rows = []
    for i in range(600):
        s = r.choice([1, 1, 1, 1, 2, 3, 4])
        text = r.choice([ROWS[i % len(ROWS)][0], "\tat x", "", None, "more"])
        rows.append((i, s, r.randrange(400), text))
    rows += [(1000, None, 5, ROWS[0][0]), (1001, 5, None, ROWS[0][0]), (1002, 6, 0, "orphan only")]
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = entries.parse_entries(raw(spark, rows), "log_source_id", "byte_offset", "raw_message", "id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((g["log_source_id"], g["byte_offset"], g["last_byte_offset"], g["log_level"], g["component"], g["message"]) for g in got) == brute_entries(rows)


def test_entries_of_nothing(spark):
    assert entries.parse_entries(raw(spark, []), "log_source_id", "byte_offset", "raw_message", "id").count() == 0


def test_entries_match_templates(spark):
    found = spark.createDataFrame(
        [(1, 0, "user 7 in  zone b"), (1, 5, "user 7 out"), (1, 9, "a\r\n\tat X(3)"), (2, 0, "user 7 in"), (3, 1, "x=1 y"), (1, 11, ""), (1, 12, "cost $1 \\\\Q")],
        "log_source_id bigint, byte_offset bigint, message string",
    )
    patterns = spark.createDataFrame(
        [(1, 1, "user <*> in zone <*>"), (2, 1, "user <*> out"), (3, 1, "user <*> <*>"), (4, 1, "a\n\tat X(<*>)"), (5, 2, "user <*> out"), (6, 1, None), (7, 1, "cost $<*> \\\\Q")],
        "id bigint, file_group_id bigint, template string",
    )
    sources = spark.createDataFrame([(1, 1), (2, 2), (4, 1)], "id bigint, file_group_id bigint")
    got = {(r["log_source_id"], r["byte_offset"]): (r["pattern_id"], r["variables"]) for r in entries.match_patterns(found, patterns, sources).collect()}
    assert got == {
        (1, 0): (None, "7"), (1, 5): (2, "7"), (1, 9): (4, "3"), (2, 0): (None, "7"), (3, 1): (None, "x=1"), (1, 11): (None, ""), (1, 12): (7, "1"),
    }
    assert entries.match_patterns(found, patterns.limit(0), sources).where("pattern_id is not null").count() == 0


# 7 -------------------------------------------------------------------------------------------------------------------


def utc(*parts, zone="UTC", fold=0):
    t = datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold)
    return round(t.timestamp()) * 10**6


RECEIVED = datetime(2026, 1, 2, 12, 0, 0)
INSTANTS = [
    ("2025-11-02T01:30:00", "America/New_York", utc(2025, 11, 2, 1, 30, zone="America/New_York")),  # twice: the earlier
    ("2025-11-02 01:30:00 EST", "America/New_York", utc(2025, 11, 2, 1, 30, zone="America/New_York", fold=1)),
    ("2025-11-02 01:30:00 EDT", "America/New_York", utc(2025, 11, 2, 1, 30, zone="America/New_York")),
    ("2026-01-01 06:28:46 AEDT", "Australia/Sydney", utc(2026, 1, 1, 6, 28, 46, zone="Australia/Sydney")),
    ("2025-12-21 05:33:52 IST", "Asia/Kolkata", utc(2025, 12, 21, 5, 33, 52, zone="Asia/Kolkata")),
    ("[2025-12-28T14:43:29.123456789+05:30]", None, utc(2025, 12, 28, 9, 13, 29) + 123456),
    ("'2025-12-28T14:43:29+01:00[Europe/Berlin]'", "Europe/Berlin", utc(2025, 12, 28, 13, 43, 29)),
    ("2025-12-28 14:43:29,5", None, utc(2025, 12, 28, 14, 43, 29) + 500000),
    ("2025-12-28T14:43", "Europe/Berlin", utc(2025, 12, 28, 13, 43)),
    ("2025/12/28 14:43:29", "Europe/Berlin", utc(2025, 12, 28, 13, 43, 29)),
    ("02/03/2026 12:05:06 AM", None, utc(2026, 2, 3, 0, 5, 6)),
    ("02/03/2026 12:05:06 PM", None, utc(2026, 2, 3, 12, 5, 6)),
    ("02.03.2026 10:05:06", None, utc(2026, 3, 2, 10, 5, 6)),
    ("28/Dec/2025:14:43:29 -0330", None, utc(2025, 12, 28, 18, 13, 29)),
    ("Sun, 28 Dec 2025 14:43:29 +0200", None, utc(2025, 12, 28, 12, 43, 29)),
    ("Dec 31 23:59:59", None, utc(2025, 12, 31, 23, 59, 59)),  # nearest year to reception
    ("Jan  2 11:00:00", "Nowhere/None", utc(2026, 1, 2, 11, 0, 0)),  # unknown zone is UTC
    ("20251228T144329Z", "Europe/Berlin", utc(2025, 12, 28, 14, 43, 29)),
    ("1766933009", "Europe/Berlin", 1766933009 * 10**6),
    ("1766933009.5", None, 1766933009 * 10**6 + 500000),
    ("1766933009123", None, 1766933009123000),
    ("1766933009123456", None, 1766933009123456),
    ("1766933009123456789", None, 1766933009123456),
    ("n/a", None, None), ("", None, None), (None, None, None), ("0000-00-00 00:00:00", None, None), ("-", None, None),
    ("2025-02-30 10:00:00", None, None), ("2025-12-28 14:43:29 XYZ", None, None), ("12", None, None),
]


def test_instants(spark):
    rows = [(i, i, t, RECEIVED, "clash") for i, (t, _, _) in enumerate(INSTANTS)]
    df = spark.createDataFrame(rows, "id bigint, src bigint, logged string, got timestamp_ntz, readings string")
    zones = spark.createDataFrame([(i, z) for i, (_, z, _) in enumerate(INSTANTS)], "log_source_id bigint, zone_name string")
    got = clock.text_instants(df.unionByName(df.where("id = 0")), "id", "src", "logged", "got", zones, spark).collect()
    assert {g["id"]: g["utc_us"] for g in got} == {i: u for i, (_, _, u) in enumerate(INSTANTS) if u is not None}
    assert sum(g["id"] == 0 for g in got) == 2  # repeated rows count each
    assert [g["ambiguous"] for g in got if g["id"] == 0] == [True, True]


def test_mixture_chooses_by_source(spark):
    """Of two orders of day and month the source's clear values decide; without any, it stays marked."""
    clear = [(i, 1, f"{13 + i}/11/2025 10:00:00", datetime(2025, 11, 13 + i, 10, 0, 5)) for i in range(15)]
    rows = [*clear, (90, 1, "03/11/2025 10:00:00", datetime(2025, 11, 3, 10, 0, 5)), (91, 2, "03/11/2025 10:00:00", None)]
    df = spark.createDataFrame(rows, "id bigint, src bigint, logged string, got timestamp_ntz")
    zones = spark.createDataFrame([], "log_source_id bigint, zone_name string")
    got = {r["id"]: r for r in clock.text_instants(df, "id", "src", "logged", "got", zones, spark).collect()}
    assert got[90]["layout"] == "day first" and not got[90]["ambiguous"] and got[90]["posterior"] > 0.9
    assert got[91]["ambiguous"]
    assert len(got) == len(rows)


def test_mixture_goes_against_custom(spark):
    """A source whose dotted dates are month first beyond doubt; one that leaves it open; one that follows custom."""
    rows = [(i, 1, f"12.{13 + i}.2025 10:00:00", datetime(2025, 12, 13 + i, 10, 0, 5)) for i in range(18)]
    rows += [(50, 1, "12.03.2025 10:00:00", datetime(2025, 12, 3, 10, 0, 5)), (51, 2, "12.03.2025 10:00:00", None)]
    rows += [(60 + i, 3, f"{13 + i}.11.2025 10:00:00", datetime(2025, 11, 13 + i, 10, 0, 5)) for i in range(18)]
    rows += [(90, 3, "12.03.2025 10:00:00", datetime(2025, 3, 12, 10, 0, 5)), (91, 3, "05.05.2025 10:00:00", datetime(2025, 5, 5, 10, 0, 5))]
    df = spark.createDataFrame(rows, "id bigint, src bigint, logged string, got timestamp_ntz")
    zones = spark.createDataFrame([], "log_source_id bigint, zone_name string")
    got = {r["id"]: r for r in clock.text_instants(df, "id", "src", "logged", "got", zones, spark).collect()}
    assert got[50]["layout"] == "dotted month first" and got[50]["utc_us"] == utc(2025, 12, 3, 10) and not got[50]["ambiguous"]
    assert got[51]["layout"] == "dotted" and got[51]["utc_us"] == utc(2025, 3, 12, 10)
    assert got[90]["layout"] == "dotted" and got[91]["posterior"] == 1.0
    assert len(got) == len(rows)


def test_numbers(spark):
    rows = [(1, None), (2, 0), (3, -1), (4, 1766933009), (5, 1766933009123), (6, 1766933009123456), (7, 1766933009123456789)]
    got = clock.number_instants(spark.createDataFrame(rows, "id bigint, n bigint"), "id", "n").collect()
    assert [(g["id"], g["layout"], g["utc_us"]) for g in got] == [
        (4, "s", 1766933009000000), (5, "ms", 1766933009123000), (6, "us", 1766933009123456), (7, "ns", 1766933009123456),
    ]
