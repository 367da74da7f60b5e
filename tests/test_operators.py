"""Catalogue operators against brute force and on odd input."""

import json
import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strataloom.operators import compare, correlate, dedup, graph, mining, rank, search, structure, tags, tickets
from strataloom.session import cut
from strataloom.operators.export import csv_lines, export_nested, read_baseline, render_page, save_baseline, write_array


def brute_components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 120)]
    nodes = sorted({n for e in edges for n in e} | {500})
    got = graph.components(
        spark.createDataFrame([(n,) for n in nodes], "id bigint"),
        spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint"),
    ).collect()
    assert {g["id"]: g["component"] for g in got} == brute_components(nodes, edges)


# Structure -----------------------------------------------------------------------------------------------------------


def lines(count):
    """A synthetic log of three kinds of entries, one of them with a stack trace."""
    out = []
    for i in range(count):
        level = "ERROR" if i % 5 == 0 else "WARN" if i % 3 == 0 else "INFO"
        head = f"2026-01-15 08:00:{i % 60:02d}.{i % 1000:03d}"
        out.append(f"{head} *{level}* [pool-thread-{i % 8}] com.app.Service - Operation completed in {i * 7 % 500}ms for request-{i}")
        if i % 10 == 0:
            out.append(f"{head} *ERROR* [pool-thread-{i % 8}] com.app.Handler - Processing failed for item-{i}")
            out.append("java.lang.RuntimeException: Something went wrong")
            out += [f"\tat com.app.Handler.process(Handler.java:{100 + i % 50})", f"\tat com.app.Service.run(Service.java:{200 + i % 30})", "\tat com.app.Main.main(Main.java:42)"]
        if i % 20 == 0:
            out.append(f"{head} *WARN* [scheduler-{i % 4}] test - Retry attempt {i // 20 + 1} for task-{i}")
    return out


def line_table(spark, text, source="a"):
    rows, at = [], 0
    for x in text:
        rows.append((source, at, at + len(x) + 1, x))
        at += len(x) + 1
    return spark.createDataFrame(rows, "source string, byte_offset bigint, next_offset bigint, line string")


def entries_of(spark, df):
    marked = structure.mark_starts(df, "source", "line", structure.entry_fingerprints(df, "source", "line"))
    return structure.group_entries(marked, "source", "byte_offset", "next_offset", "line")


@pytest.mark.parametrize(("count", "n_lines", "n_entries", "n_templates"), [(20, 31, 23, 23), (80, 124, 92, 92), (200, 310, 230, 217)])
def test_generator_structure(spark, count, n_lines, n_entries, n_templates):
    text = lines(count)
    assert len(text) == n_lines
    e = entries_of(spark, line_table(spark, text)).withColumn("group", F.lit("g"))
    assert e.count() == n_entries
    v = mining.distinct_vectors(mining.tokenized(e, "group", "source", "byte_offset", "primary_line", "continuation"))
    for templates in (mining.strict_templates(v), mining.fold_templates(v)):
        assert mining.mined_patterns(templates).count() == n_templates


def test_two_start_shapes(spark):
    text = []
    for i in range(50):
        text += [f"2026-01-15 10:00:{i:02d}.000 *ERROR* [thread-{i % 4}] com.app.Handler - Request failed", "java.lang.NullPointerException: Value was null", f"\tat com.app.Handler.run(Handler.java:{50 + i})", "\tat com.app.Main.main(Main.java:42)"]
    e = entries_of(spark, line_table(spark, text)).withColumn("group", F.lit("g"))
    assert e.count() == 100
    v = mining.distinct_vectors(mining.tokenized(e, "group", "source", "byte_offset", "primary_line", "continuation"))
    assert mining.mined_patterns(mining.strict_templates(v)).count() == 54


def test_leading_orphans_and_blank_lines(spark):
    df = line_table(spark, ["\torphan", "a: 1", "", "  more", "a: 2"])
    got = entries_of(spark, df).orderBy("byte_offset").collect()
    assert [(g["primary_line"], g["continuation"]) for g in got] == [("a: 1", ["", "  more"]), ("a: 2", [])]
    assert entries_of(spark, df.limit(0)).count() == 0
    blank = line_table(spark, ["", ""])  # no shapes: every line is an entry
    assert entries_of(spark, blank).count() == 2


@pytest.mark.parametrize("size", ["3", "10000"])
def test_entries_equal_brute_force(spark, size):
    """Sources of any length over tasks and batches; null lines are empty ones, a null start is none."""
    r = random.Random(int(size))
    rows = [(s, i, i + 1, r.choice(["a", "b", "", None]), r.choice([True, False, False, False, None])) for s in "abcdefg" for i in range(r.choice([1, 2, 60]))]
    rows += [("z", i, i + 1, str(i), i == 0) for i in range(90)] + [("y", i, i + 1, "x", False) for i in range(40)] + [(None, 1, 2, "x", True), ("a", None, 2, "x", True)]
    want, now = [], None
    for s, at, after, line, start in sorted((x for x in rows if x[0] is not None and x[1] is not None), key=lambda x: x[:2]):
        if start:
            now = [s, at, after, line or "", []]
            want.append(now)
        elif now is not None and now[0] == s:
            now[2] = after
            now[4].append(line or "")
    df = spark.createDataFrame(rows, "s string, at bigint, after bigint, line string, is_start boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = sorted((list(x) for x in structure.group_entries(df, "s", "at", "after", "line").collect()), key=lambda x: (x[0], x[1]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


# Mining --------------------------------------------------------------------------------------------------------------


def masked_table(spark, vectors):
    rows = [("g", "s", i, v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "group string, source string, byte_offset bigint, masked array<string>")


def random_vectors(seed, low, high):
    r = random.Random(seed)
    kinds = [[r.choice(["get", "put", "x", "y"]) for _ in range(r.randrange(low, high))] for _ in range(5)]
    out = []
    for _ in range(150):
        v = list(r.choice(kinds))
        for i in range(14, len(v)):
            if r.random() < 0.2:
                v[i] = r.choice(["p", "q", "r"])
        out.append(v)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strict_equals_fold_up_to_28_tokens(spark, seed):
    v = mining.distinct_vectors(masked_table(spark, random_vectors(seed, 3, 28)))
    show = lambda t: sorted((tuple(r["masked"]), tuple(r["template"])) for r in t.collect())
    assert show(mining.strict_templates(v)) == show(mining.fold_templates(v))


@pytest.mark.parametrize("seed", range(3))
def test_fold_in_parts_equals_fold_as_a_whole(spark, seed):
    """Wildcards before and after literals, tokens that fall back on them, and templates that evolve."""
    r = random.Random(100 + seed)
    kinds = [["svc" + r.choice("abc"), r.choice(["x", "y", "<*>"]), r.choice("pqr")] for _ in range(8)]
    vectors = []
    for _ in range(900):
        head = [*r.choice(kinds), *(r.choice(["k", "<*>", "m"]) if r.random() < 0.2 else "k" for _ in range(11))]
        size = r.choice([6, 16, 30, 40])
        vectors.append((head + [r.choice(["u", "v", "w", "<*>"]) for _ in range(40)])[:size])
    df = masked_table(spark, vectors).withColumn("n", F.lit(1)).groupBy("group", "masked").agg(F.count("*").alias("n"), F.min(F.struct("source", "byte_offset")).alias("first"))
    show = lambda t: sorted((tuple(x["masked"]), tuple(x["template"])) for x in t.collect())
    whole = show(mining.fold_templates(df))
    assert show(mining.fold_templates(df, most=25)) == whole
    units = mining.fold_units(df, 25).groupBy("size").agg(F.count_distinct("unit").alias("u")).collect()
    assert max(x["u"] for x in units) > 2
    assert any("<*>" in t and "<*>" not in m for m, t in whole)


def test_fold_of_distinct_equals_fold_of_all():
    vectors = random_vectors(3, 20, 45)
    a, b = mining.PrefixTree(), mining.PrefixTree()
    for v in vectors:
        a.add(v)
    for v in dict.fromkeys(map(tuple, vectors)):
        b.add(list(v))
    assert sorted(map(tuple, a.templates)) == sorted(map(tuple, b.templates))


def test_all_templates_of_a_leaf_are_looked_at():
    head = [f"w{i}" for i in range(14)]
    vectors = [[*head, *(f"x{i}-{k}" for k in range(20))] for i in range(60)]
    t, parity = mining.PrefixTree(), mining.PrefixTree(most=mining.MOST_CANDIDATES)
    assert [t.add(v) for v in vectors] == list(range(60)) == [t.add(v) for v in vectors]
    assert [parity.add(v) for v in vectors * 2] == [*range(60), *range(50), *range(60, 70)]


def test_line_breaks_keep_templates_apart():
    t = mining.PrefixTree()
    head = [f"w{i}" for i in range(14)]
    a = t.add([*head, "x", "\n", "y"])
    assert t.add([*head, "\n", "x", "y"]) != a
    assert t.add([*head, "z", "\n", "y"]) == a
    assert t.templates[a][14:] == ["<*>", "\n", "y"]


def test_fallback_on_wildcard_branch():
    t = mining.PrefixTree()
    a = t.add(["user", "<*>", "in"])
    assert t.add(["user", "bob", "in"]) == a
    b = t.add(["host", "bob", "in"])
    assert a != b
    with pytest.raises(ValueError, match="threshold"):
        mining.fold_templates(None, 1.5)


# Pairs ---------------------------------------------------------------------------------------------------------------


def template_rows(seed, n=120):
    r = random.Random(seed)
    base = [[r.choice("abcdefgh") * 2 for _ in range(r.choice([4, 8, 22]))] for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(r.choice(base))
        for k in range(len(t)):
            if r.random() < 0.08:
                t[k] = r.choice(["<*>", "zz", "yy"])
        rows.append((i, r.choice([1, 1, 2, None]), t))
    return rows


def alike(a, b):
    return sum(x == y or "<*>" in (x, y) for x, y in zip(a, b)) / len(a) if len(a) == len(b) else 0.0


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.95, 1.0])
def test_structural_pairs_brute(spark, threshold):
    rows = template_rows(4)
    df = spark.createDataFrame(rows, "id bigint, group bigint, tokens array<string>")
    got = {(g["a"], g["b"]) for g in dedup.structural_pairs(df, threshold).collect()}
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if a[1] == b[1] and alike(a[2], b[2]) >= threshold}
    assert got == want


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_structural_pairs_of_mostly_open_templates(spark, threshold):
    r = random.Random(12)
    words = lambda n, p: ["<*>" if r.random() < p else r.choice("abc") for _ in range(n)]
    rows = [(i, r.choice([1, 1, None]), words(r.choice([4, 6]), r.choice([0.1, 0.5, 0.9]))) for i in range(160)]
    df = spark.createDataFrame(rows, "id bigint, group bigint, tokens array<string>")
    got = {(g["a"], g["b"]) for g in dedup.structural_pairs(df, threshold).collect()}
    assert got == {(a[0], b[0]) for a, b in combinations(rows, 2) if a[1] == b[1] and alike(a[2], b[2]) >= threshold}


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_semantic_pairs_brute(spark, threshold):
    rows = template_rows(6, 80)
    df = spark.createDataFrame(rows, "id bigint, group bigint, tokens array<string>")
    vectors = {}
    for g in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == g]
        n, count = len(mine), Counter(t for r in mine for t in set(r[2]) if t != "<*>")
        idf = {t: math.log(n / c) * (0.1 if c / n > 0.8 else 1) for t, c in count.items()}
        for r in mine:
            vectors[r[0]] = (g, {t: c / len(r[2]) * idf[t] for t, c in Counter(r[2]).items() if t != "<*>"})
    want = set()
    for a, b in combinations(sorted(vectors), 2):
        (ga, x), (gb, y) = vectors[a], vectors[b]
        norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        if ga == gb and norm and sum(v * y.get(k, 0) for k, v in x.items()) / norm >= threshold - 1e-9:
            want.add((a, b))
    got = {(g["a"], g["b"]) for g in dedup.semantic_pairs(df, threshold).collect()}
    assert got == want


def test_duplicate_classes(spark):
    p = spark.createDataFrame(
        [(1, 1, "a <*> c", 5), (2, 1, "a b c", 1), (3, 1, "a b <*>", 0), (4, 1, "x y z", 1), (5, 2, "a b c", 1), (6, 1, None, 1)],
        "id bigint, file_group_id bigint, template string, occurrence_count bigint",
    )
    got = {g["id"]: (g["component"], g["n_links"]) for g in dedup.duplicate_classes(p).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2)}
    assert dedup.duplicate_classes(p.limit(0)).count() == 0


def test_correlations_brute(spark):
    r = random.Random(9)
    occ = [(i, r.randrange(6), 1_767_000_000 + r.randrange(400)) for i in range(300)] + [(900, 1, None), (901, 2, 0)]
    patterns = [(i, i % 3, 10 if i else 9) for i in range(6)]
    o = spark.createDataFrame(occ, "id bigint, pattern_id bigint, entry_timestamp bigint")
    p = spark.createDataFrame(patterns, "id bigint, file_group_id bigint, occurrence_count bigint")
    timed = [(t, k) for _, k, t in occ if t and k]
    lags = {}
    for (t1, a), (t2, b) in combinations(timed, 2):
        if a % 3 != b % 3 and abs(t1 - t2) <= 7:
            lags.setdefault((min(a, b), max(a, b)), []).append(abs(t1 - t2))
    got = {(g["a"], g["b"]): (g["observed"], g["median_lag"]) for g in correlate.correlations(o, p, 7, 10, None, None, 0, 0.0).collect()}
    assert got == {k: (len(v), sorted(v)[len(v) // 2]) for k, v in lags.items()}


def test_clusters(spark):
    occ = [(i, k, "\t".join([f"value{x}" for x in xs] + ["5", "x"])) for i, (k, xs) in enumerate([(1, [1, 2, 3]), (2, [1, 2, 3]), (3, [3, 4]), (4, [9, 4]), (5, []), (6, [7, 8])])]
    o = spark.createDataFrame([*occ, (99, 1, None), (98, 2, "")], "id bigint, pattern_id bigint, variables string")
    p = spark.createDataFrame([(i, 10 - i) for i in range(1, 7)], "id bigint, occurrence_count bigint")
    got = correlate.clusters(o, p, min_shared=1).collect()
    assert [(g["cluster"], g["patterns"], g["values"]) for g in got] == [(1, [1, 2], ["value1", "value2"]), (3, [3, 4], ["value4"])]


def test_shared_values_of_all_patterns(spark):
    """The rarest of 260 patterns share values as much as any; one value is held by 130 of them."""
    held = {i: {"common"} if i <= 130 else set() for i in range(1, 261)}
    for a, b in ((1, 2), (220, 250), (250, 260)):
        for x in (held[a], held[b]):
            x |= {f"link{a}-{b}-{k}" for k in range(3)}
    held = {i: v or {f"own{i}"} for i, v in held.items()}
    o = spark.createDataFrame([(i, i, "\t".join(v)) for i, v in held.items()], "id bigint, pattern_id bigint, variables string")
    p = spark.createDataFrame([(i, 1000 - i) for i in held], "id bigint, occurrence_count bigint")
    shared = correlate.shared_values(correlate.variable_index(o, p))
    for least in (1, 3):
        want = {(a, b): n for a, b in combinations(held, 2) if (n := len(held[a] & held[b])) >= least}
        assert {(g["a"], g["b"]): g["shared"] for g in correlate.shared_value_pairs(shared, least).collect()} == want
    assert [g["patterns"] for g in correlate.clusters(o, p).collect()] == [[220, 250, 260], [1, 2]]
    assert correlate.variable_index(o, p, 200).agg(F.max("pattern_id")).first()[0] == 200


def test_forest_keeps_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(400)] + [(1, None)]

    def parts(pairs):
        of = {i: {i} for i in range(300)}
        for x, y in pairs:
            if y is not None and of[x] is not of[y]:
                of[x] |= of[y]
                of.update(dict.fromkeys(of[y], of[x]))
        return sorted({tuple(sorted(v)) for v in of.values()})

    kept = [tuple(e) for e in graph.forest(spark.createDataFrame(edges, "a bigint, b bigint").repartition(1)).collect()]
    assert set(kept) <= set(edges) and len(kept) == 300 - len(parts(edges)) and parts(kept) == parts(edges)


# Comparison ----------------------------------------------------------------------------------------------------------


def test_diff_and_baseline(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "group string, template string, occurrence_count bigint")
    before = make([("g", "same", 10), ("g", "gone", 4), ("g", "more", 2), ("g", "zero", 0), ("h", "twice", 5)])
    after = make([("g", "same", 15), ("g", "new", 1), ("g", "more", 5), ("g", "zero", 3), ("h", "twice", 10), ("g", "unseen", 0)])
    got = {(d["kind"], d["template"]): d["percent"] for d in compare.diff(before, after).collect()}
    assert got == {("resolved", "gone"): None, ("new", "new"): None, ("changed", "more"): "+150%"}
    save_baseline(before, str(tmp_path / "b"))
    assert read_baseline(spark, str(tmp_path / "b")).count() == 4
    with pytest.raises(Exception, match="exist"):
        save_baseline(before, str(tmp_path / "b"))


def small_model(spark):
    p = [(i, 1, f"t{i}", 10) for i in range(1, 13)] + [(13, 1, "big", 10_000), (14, 2, "alone", None)]
    return (
        spark.createDataFrame(p, "id bigint, file_group_id bigint, template string, occurrence_count bigint"),
        spark.createDataFrame([(1, "a.log"), (2, "b.log")], "id bigint, name string"),
        spark.createDataFrame([(i, s, i, i * 10, 1_767_000_000 + i, f"v{i}") for i in range(1, 14) for s in (1, 2)] + [(0, 3, 14, 0, None, None)], "id bigint, log_source_id bigint, pattern_id bigint, byte_offset bigint, entry_timestamp bigint, variables string"),
        spark.createDataFrame([(1, "/x/a.log", 1), (2, "/x/a.log.1", 1), (3, "/x/b.log", 2)], "id bigint, file_path string, file_group_id bigint"),
    )


def test_anomalies_and_gate(spark):
    p, g, o, s = small_model(spark)
    got = compare.anomalies(p, g, o, s).collect()
    assert [a["pattern_id"] for a in got] == [13]
    assert got[0]["reasons"][0].startswith("high-count outlier (z=3.")
    gone = spark.createDataFrame([(13,)], "pattern_id bigint")
    assert compare.anomalies(p, g, o, s, suppressed=gone).count() == 0
    gate = {r["name"]: r["passed"] for r in compare.gate(compare.anomalies(p, g, o, s), None, p, 3.0, 5, ("big", "none'")).collect()}
    assert gate == {"max anomaly score": False, "max new patterns (skipped: no baseline)": True, "no pattern contains 'big'": False, 'no pattern contains "none\'"': True}
    one = o.where("pattern_id <> 5 or log_source_id = 1")
    assert {a["pattern_id"]: a["score"] for a in compare.anomalies(p, g, one, s).collect()}[5] == 2.0


def test_report_page_and_csv(spark):
    p, g, o, s = small_model(spark)
    t = spark.createDataFrame([(13, "critical"), (13, "critical"), (1, "suppress")], "pattern_id bigint, tag string")
    r = rank.report(p, g, o, s, t, top=3, suppressed=tags.suppressed(t))
    first = r.collect()[0]
    assert first["pattern_id"] == 13 and first["tags"] == ["critical"] and len(first["trend"]) == 1 and len(first["distribution"]) == 2
    page = render_page(r, "Report </script>")
    assert page.startswith("<!DOCTYPE html>") and "const DATA" in page and "has_timestamps" in page and page.count("</script>") == 1
    empty = rank.report(p.limit(0), g, o, s)
    assert empty.count() == 0
    rows = spark.createDataFrame([(1, 'a "b", c', None)], "id int, template string, sample_1 string")
    assert [x[0] for x in csv_lines(rows).collect()] == ['1,"a ""b"", c",']


# Search, tags, tickets -----------------------------------------------------------------------------------------------

TEXTS = ["Connection lost to host", "connection RESET by peer", "host lost", "Reset connection pool", "", None]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("connection", [0, 1, 3]), ("connection lost", [0]), ("lost AND host", [0, 2]), ("lost OR peer", [0, 1, 2]),
        ("connection NOT lost", [1, 3]), ('"connection lost"', [0]), ('"lost connection"', []), ("conn*", [0, 1, 3]),
        ("(lost OR reset) connection", [0, 1, 3]), ('"reset conn"*', []),
    ],
)
def test_search(spark, query, want):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, template string")
    assert [r["pattern_id"] for r in search.search(df, query).collect()] == want


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("NEAR(e d, 3)", [1]), ("NEAR(e d, 2)", []), ('NEAR("c d" "e f", 3)', [1]), ("NEAR(a d e, 6)", [1]), ("NEAR(a d e, 5)", []),
        ("NEAR(b a)", [1, 2]), ("template: a NOT e", [2]), ("template:(z OR f)", [1, 3]), ("-template: a", []), ("{template}: z", [3]), ("^a", [1, 2]),
        ("^b", []), ("NEAR(a q, 100)", []),
    ],
)
def test_search_groups_and_columns(spark, query, want):
    p = spark.createDataFrame([(1, "A B C D x x x E F x"), (2, "a b"), (3, "z"), (4, ""), (5, None)], "id bigint, template string")
    assert [r["pattern_id"] for r in search.search(p, query).collect()] == want


@pytest.mark.parametrize("query", ["", "a NEAR b", "(a", "a )", "title:a", "OR"])
def test_search_refuses(spark, query):
    with pytest.raises(ValueError):
        search.parse_query(query, F.array())


def test_tags(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "suppress"), (3, "Ignore")], "pattern_id bigint, tag string")
    show = lambda df: sorted(map(tuple, df.collect()))
    assert show(tags.set_tags(t, 1, ["c", "c"])) == [(1, "c"), (2, "suppress"), (3, "Ignore")]
    assert show(tags.add_tag(t, 1, "a")) == show(t)
    assert show(tags.remove_tag(t, 1, "a")) == [(1, "b"), (2, "suppress"), (3, "Ignore")]
    assert show(tags.suppressed(t)) == [(2,)]
    f = tmp_path / "tags.json"
    f.write_text('{"1": ["suppress"], "x": ["a"], "2": ["b", "c"]}')
    assert show(tags.read_tag_file(spark, str(f))) == [(1, "suppress"), (2, "b"), (2, "c")]
    f.write_text("{broken")
    assert show(tags.read_tag_file(spark, str(f))) == []


def test_previews(spark):
    p = spark.createDataFrame([(1, 1, "a\n  b"), (2, None, "x" * 90), (3, 1, None)], "id bigint, file_group_id bigint, template string")
    g = spark.createDataFrame([(1, "g")], "id bigint, name string")
    pairs = spark.createDataFrame([(1, 2, 3.0), (1, 3, 4.0)], "a bigint, b bigint, confidence double")
    got = [tuple(r) for r in correlate.described(pairs, p, g).select("b", "group_a", "template_a", "group_b", "template_b").collect()]
    assert got == [(3, "g", "a b", "g", None), (2, "g", "a b", None, "x" * 77 + "...")]
    c = spark.createDataFrame([(1, 3, [1, 2, 3])], "cluster bigint, n_patterns bigint, patterns array<bigint>")
    assert correlate.described_clusters(c, p, 2).first()["templates"] == ["a b", "x" * 77 + "..."]


def test_correlations_in_parts_are_the_same(spark, monkeypatch):
    r = random.Random(8)
    occ = [(i, r.randrange(9), 1_760_000_000 + int(r.random() ** 3 * 900)) for i in range(700)]
    o = spark.createDataFrame(occ, "id bigint, pattern_id bigint, entry_timestamp bigint")
    p = spark.createDataFrame([(i, i % 3, 50) for i in range(9)], "id bigint, file_group_id bigint, occurrence_count bigint")
    show = lambda: [tuple(x) for x in correlate.correlations(o, p, 60, 1, None, min_confidence=0.0).collect()]
    whole = show()
    monkeypatch.setattr(correlate, "BIN_ROWS", 20)
    assert show() == whole and len(whole) > 20


def test_export_nested(spark, tmp_path):
    p = spark.createDataFrame([(1, 1, "user <*> in", 3), (2, 1, "off", 1)], "id bigint, file_group_id bigint, template string, occurrence_count bigint")
    g = spark.createDataFrame([(1, "g")], "id bigint, name string")
    s = spark.createDataFrame([(5, "/var/log/a.log")], "id bigint, file_path string")
    o = spark.createDataFrame([(1, 5, 1, 0, "x"), (2, 5, 1, 9, "y")], "id bigint, log_source_id bigint, pattern_id bigint, byte_offset bigint, variables string")
    path = tmp_path / "out.json"
    write_array(export_nested(p, g, o, s), str(path))
    assert json.loads(path.read_text()) == [
        {"id": 1, "group": "g", "template": "user <*> in", "occurrence_count": 3, "samples": [{"text": "user x in", "source": "a.log"}, {"text": "user y in", "source": "a.log"}]},
        {"id": 2, "group": "g", "template": "off", "occurrence_count": 1, "samples": []},
    ]


def test_select_patterns(spark):
    p = spark.createDataFrame([(1, "ERROR user <*> login failed", 100), (2, "WARN timeout after <*>ms", 50), (3, "INFO request completed", 500), (4, "ERROR database connection lost", 10)], "id bigint, template string, occurrence_count bigint")
    t = spark.createDataFrame([(1, "critical"), (4, "suppressed")], "pattern_id bigint, tag string")
    known = spark.createDataFrame([(1,), (3,)], "pattern_id bigint")
    n = lambda **k: tags.select_patterns(p, t, **k).count()
    assert (n(), n(min_count=50), n(any_of=["critical"]), n(none_of=["suppressed"]), n(known=known), n(min_count=50, none_of=["suppressed"])) == (4, 3, 1, 3, 2, 3)


def test_tickets(spark):
    p = spark.createDataFrame([(7, "a\nb", 1500), (8, "c", 5), (9, "d", 0)], "id bigint, template string, occurrence_count bigint")
    body = spark.createDataFrame([(7, "a\nb", "g", 1500, ["x", "y"])], "pattern_id bigint, template string, group string, occurrence_count bigint, samples array<string>")
    made = tickets.body(body, "prod").first()
    assert made["summary"] == "Log pattern: a b" and "1,500" in made["description"]
    t = spark.createDataFrame([("K-1", made["description"]), ("K-2", "prod;8;4"), ("K-3", "text prod;9;1"), ("K-4", None), ("K-5", ";1;1")], "key string, description string")
    assert {r["pattern_id"]: (r["key"], r["action"]) for r in tickets.plan(p, t, "prod").collect()} == {7: ("K-1", "unchanged"), 8: ("K-2", "update"), 9: (None, "create")}
    assert tickets.plan(p, t, "prod", create=False).count() == 2
    assert tuple(tickets.status(p, t, "prod").first()) == (2, 2, 0, 1)
    doc = {"type": "doc", "content": [{"type": "paragraph", "content": [{"text": "a"}, {"text": "b"}]}, {"type": "codeBlock", "content": [{"text": "prod;1;2"}]}]}
    assert tickets.document_text(doc) == "ab\nprod;1;2\n"
