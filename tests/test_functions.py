import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions import tokens as tk
from strataloom.functions.stamps import extract_timestamp


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select(column(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def brute_tokens(line):
    out, now, depth = [], "", 0
    for c in line:
        if c in " \t\n\f\r" and depth <= 0:
            if now:
                out.append(now)
            now, depth = "", 0
        else:
            now += c
            depth += (c in "([") - (c in ")]")
    return out + ([now] if now else [])


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("\tat com.example.reflect.Accessor.invoke0(Native Method)", ["at", "com.example.reflect.Accessor.invoke0(Native Method)"]),
        ("*INFO* [Background Worker Pool Thread] ServiceImpl", ["*INFO*", "[Background Worker Pool Thread]", "ServiceImpl"]),
        ("a(b c d", ["a(b c d"]),
        ("a)(b c", ["a)(b", "c"]),
        ("[x (y] z) w", ["[x (y] z)", "w"]),
        ("", []),
    ],
)
def test_tokenize(spark, line, want):
    assert values(spark, [line], tk.tokenize) == [want]


def test_tokenize_null(spark):
    assert values(spark, [None], tk.tokenize) == [None]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(st.text(alphabet="ab ()[]\t\x0b1-", max_size=24), min_size=1, max_size=40))
def test_tokenize_brute(spark, lines):
    assert values(spark, lines, tk.tokenize) == [brute_tokens(x) for x in lines]


def test_variable_heuristic(spark):
    yes = ["2025-03-15", "192.168.1.100", "14:05:33.710", "/a", "a\\b", "550e8400-e29b-41d4-a716-446655440000"]
    no = ["com.example.app.Widget.process(Widget.java:538)", "[com.example.module.resolver:1.7.10.B004]", "\n", "", "request-99"]
    assert values(spark, yes + no, tk.is_variable) == [True] * len(yes) + [False] * len(no)


def test_shape_and_fingerprint(spark):
    assert values(spark, ["23.10.2024", "aB9--x", ""], tk.token_shape) == ["d.d.d", "ad-a", ""]
    assert values(spark, ["2026-01-15 08:00:00.1 x", "one", "  ", None], tk.line_fingerprint) == ["d-d-d|d:d:d.d", "a", "", ""]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("2026-01-15T08:00:00.123Z", 1768464000),
        ("2026-01-15T08:00:00Z x", 1768464000),
        ("2026-01-15T08:00:00+02:00", 1768456800),
        ("2026-01-15 08:00:00,123", 1768464000),
        ("2026-01-15 08:00:00.123", 1768464000),
        ("2026-01-15 08:00:00 INFO", 1768464000),
        ("15/Mar/2026:08:00:00 +0000", 1773561600),
        ("[15/Mar/2026:08:00:00 +0200]", 1773561600),
        ("Mar 15 08:00:00 host", 1773561600),
        ("Mar  5 08:00:00 host", 1772697600),
        ("1742000000 some event", 1742000000),
        ("17420000001", None),
        ("2026-13-15 08:00:00", None),
        ("just a line", None),
        ("äöü", None),
        ("", None),
        (None, None),
    ],
)
def test_timestamp(spark, line, want):
    assert values(spark, [line], lambda c: extract_timestamp(c, 2026)) == [want]


@pytest.mark.parametrize(
    ("path", "group"),
    [
        ("error.log.2026-03-01", "error.log"),
        ("/var/log/error.log.2026-10-23", "error.log"),
        ("error.20260301.log", "error.log"),
        ("error.log.42", "error.log"),
        ("access.log.1", "access.log"),
        ("/home/user/logs/app.log", "app.log"),
        ("app_2026_03_15.log", "app.log"),
        ("app-2026-03-15.log", "app.log"),
        ("app8080.log", "app.log"),
        ("server8080.log", "server.log"),
        ("test2.log", "test.log"),
        ("watch-test.log", "watch.test.log"),
        ("2026-01-01", "2026-01-01"),
    ],
)
def test_group_name(spark, path, group):
    assert values(spark, [path], tk.group_name) == [group]


def test_render_parse_reconstruct(spark):
    tokens = ["msg", "hello", "\n", "at", "Foo.bar()", "\n", "at", "Baz.qux()"]
    text = "msg hello\nat Foo.bar()\nat Baz.qux()"
    assert values(spark, [tokens], tk.render, "array<string>") == [text]
    assert values(spark, [text], tk.parse_template) == [tokens]
    made = values(spark, ["a <*> b <*> c <*>"], lambda c: tk.reconstruct(c, F.split(F.lit("1\t2"), "\t")))
    assert made == ["a 1 b 2 c <*>"]


def test_similarity(spark):
    df = spark.createDataFrame(
        [(["a", "b"], ["a", "c"]), (["a", "<*>"], ["a", "c"]), (["a"], ["a", "b"]), ([], []), (["a", "\n"], ["a", "b"])],
        "a array<string>, b array<string>",
    )
    assert [r[0] for r in df.select(tk.similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 1.0, 0.0]


def test_csv_cell(spark):
    assert values(spark, ["a", 'a"b', "a,b", "a\nb", ""], tk.csv_cell) == ["a", '"a""b"', '"a,b"', '"a\nb"', ""]


def test_words_are_alnum_runs():
    from strataloom.operators.search import _TERM

    assert _TERM.findall("ab_c É1") == re.findall(r"[^\W_]+", "ab_c É1")
