"""The training-data operators: against brute force, and on odd input."""

import random
import re
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import groups, leaks, queries, repetition, runs, terms, words
from strataloom.llm.mixture import Mixture, apportion
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, data, name):
    same(queries.QUERIES[name](spark, data), queries.SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


# 1 -------------------------------------------------------------------------------------------------------------------

PATTERNS = [
    (1, 1, "a b c", 0), (2, 1, "a <*> c", 0), (3, 1, "a x c", 0), (4, 1, "a b", 0), (5, 2, "a b c", 0), (6, 1, None, 0),
    (7, None, "a b c", 0), (8, 1, "<*> b d", 0), (9, 1, "", 0),
]


def alike(p, q):
    if p == q:
        return True
    known = {i: (g, t) for i, g, t, _ in PATTERNS}
    if p not in known or q not in known:
        return False
    (g, a), (h, b) = known[p], known[q]
    if g is None or g != h or a is None or b is None:
        return False
    a, b = a.split(), b.split()
    return len(a) == len(b) and all(x == y or "<*>" in (x, y) for x, y in zip(a, b))


def brute_runs(rows):
    first = {}
    for i, s, o, p, _ in sorted(rows, key=lambda r: r[0]):
        if None not in (s, o, p):
            first.setdefault((s, o), p)
    out, chain = [], []
    for key in [*sorted(first), None]:
        if chain and (key is None or key[0] != chain[-1][0] or not alike(first[chain[-1]], first[key])):
            if len(chain) >= 3:
                out.append((chain[0][0], chain[0][1], chain[-1][1], len(chain)))
            chain = []
        if key:
            chain.append(key)
    return sorted(out)


def find_runs(spark, rows):
    events = spark.createDataFrame(rows, "id bigint, log_source_id bigint, byte_offset bigint, pattern_id bigint, ts bigint")
    events = events.withColumns({c: F.lit("z") for c in ("source", "symbol", "key", "detail", "seam", "place")})
    patterns = spark.createDataFrame(PATTERNS, "id bigint, file_group_id bigint, template string, key bigint")
    classes = runs.event_classes(patterns, "id", "file_group_id", "template")
    found = runs.repeated_runs(events, "log_source_id", "byte_offset", "pattern_id", "id", F.col("ts"), classes)
    return sorted((r["log_source_id"], r["first_byte_offset"], r["last_byte_offset"], r["n_events"]) for r in found.collect())


def random_events(seed, n=1500):
    r = random.Random(seed)
    rows = [(i, r.choice([1, 1, 1, 1, 2, 3, None]), r.randrange(n // 2), r.choice([1, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 99, None]), None) for i in range(n)]
    return rows + [(10_000 + i, 7, i, 3, 5 * i) for i in range(400)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_runs_equal_brute_force(spark, adaptive):
    rows = random_events(1)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        assert find_runs(spark, rows) == brute_runs(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_runs_over_many_blocks():
    """Blocks of a few rows: every run is put together from seams."""
    import pyarrow as pa

    rows = sorted((s, o, p) for _, s, o, p, _ in random_events(2, 300) if None not in (s, o, p))
    columns = [pa.array(c) for c in zip(*[(s, o, p, p, None, None) for s, o, p in rows])]
    columns[4], columns[5] = columns[4].cast(pa.string()), columns[5].cast(pa.int64())
    table = pa.table(columns, names=["source", "offset", "pattern", "symbol", "detail", "time"])
    old, runs._BLOCK = runs._BLOCK, 7
    try:
        out = [r for b in runs._find(3)(iter(table.to_batches(max_chunksize=3))) for r in b.to_pylist()]
    finally:
        runs._BLOCK = old
    events = {(s, o) for s, o, _ in rows}
    whole = [r for r in out if not r["seam"]]
    assert all(r["n"] >= 3 for r in whole)
    assert sum(r["n"] for r in out if r["seam"]) <= len(events)
    covered = [r for r in out if r["seam"]]
    assert all(r["at_start"] or r["at_end"] for r in covered)


def test_runs_report_times(spark):
    rows = [(1, 1, 0, 3, None), (2, 1, 1, 3, 50), (3, 1, 2, 3, 20), (4, 1, 2, 4, 999)]
    events = spark.createDataFrame(rows, "id bigint, s bigint, o bigint, p bigint, t bigint")
    classes = runs.event_classes(spark.createDataFrame([], "id bigint, g bigint, t string"), "id", "g", "t")
    (r,) = runs.repeated_runs(events, "s", "o", "p", "id", F.col("t"), classes).collect()
    assert (r["n_events"], r["first_us"], r["last_us"], r["duration_us"]) == (3, 20, 50, 30)
    assert runs.repeated_runs(events.limit(0), "s", "o", "p", "id", F.col("t"), classes).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------


def brute_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in up if find(n) != n}


@pytest.mark.parametrize("most", [5, 60, 10**6])
def test_components(spark, most):
    r = random.Random(7)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)]
    edges += [(400, i) for i in range(401, 440)] + [(3, 3), (None, 4), (5, None)] + edges_twice(r)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)
    got = {x["node"]: x["root"] for x in groups.components(df, "a", "b", most).collect()}
    assert got == brute_components(edges)


def edges_twice(r):
    return [(r.randrange(20), r.randrange(20))] * 3


def test_components_of_nothing(spark):
    assert groups.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("0c42646011e67317", 1), ('"0c42646011e67317"', 1), ("{DFF309DF62AC6C3B}", 1), ("0x6d40a5fb6b9d5405", 1), ("4A2A73C5:EAFC0C61", 1),
        ("trace:e4e124d075c71f4f", 1), ("[corr=9D13AC7A445AD4B1]", 1), ("c97a-4806-dc58-c34b", 1), ("1111111111111111", 0), ("0c42646011e6731", 0),
        ("0c42646011e673170", 0), ("198.51.100.182:47768", 0), ("host=198.51.100.182:47768", 0), ("[198.51.100.182]:47768", 0),
        ("deadbeef:01234567", 0), ("0c42.6460.11e6.7317", 1), ("[trace:0x0c42646011e67317]", 1), ('req="0C42-6460-11E6-7317"', 1), ("0C42646011E67317\t0x0c42646011e67317", 1), ("0c42646011e67317\t0c42646011e67318", 2),
        ("", 0), (None, 0), ("req=0x6d40a5fb6b9d5405", 1), ("0c42646011e6731g", 0), ("ffffffffffffffff", 0), ("fffffffffffffffe", 1),
    ],
)
def test_identifiers(spark, text, n):
    df = spark.createDataFrame([(text,)], "v string")
    got = df.select(F.size(F.coalesce(groups.identifiers(F.col("v")), F.array().cast("array<bigint>")))).first()[0]
    assert got == n


@pytest.mark.parametrize("most", [2, 10**6])
def test_links(spark, most):
    r = random.Random(11)
    names = [f"{r.getrandbits(64):016x}" for _ in range(40)]
    rows = []
    for i in range(300):
        held = [r.choice(names) if r.random() < 0.97 else f"{r.getrandbits(64):016x}" for _ in range(r.choice([0, 1, 1, 1, 2]))]
        rows.append((i, int(held[0][:2], 16) % 3 if held else 1, "\t".join(x.upper() if r.random() < 0.5 else "0x" + x for x in held)))
    rows += [(1000, None, names[0]), (1001, 1, None), (1002, 9, ""), (1003, 5, "7" * 16)]
    kinds = {}
    parse = lambda v: [x.lower().removeprefix("0x") for x in (v or "").split("\t") if x and x != "7" * 16]
    for _, k, v in rows:
        for x in parse(v):
            kinds.setdefault(x, set()).add(k)
    links = {x for x, k in kinds.items() if len(k - {None}) > 1}
    members = [(i, x) for i, _, v in rows for x in parse(v) if x in links]
    up = {}

    def find(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for i, x in members:
        up[find(("x", x))] = find(("i", i))
    best = {}
    for i, _ in members:
        best[find(("i", i))] = min(best.get(find(("i", i)), i), i)
    want = sorted({(i, best[find(("i", i))]) for i, _ in members})
    df = spark.createDataFrame(rows, "id bigint, pattern_id bigint, variables string").withColumns({c: F.lit(1) for c in ("kind", "n", "i", "first", "node")})
    assert sorted(map(tuple, groups.linked_by_identifiers(df, "id", "pattern_id", "variables", most).collect())) == want
    assert groups.linked_by_identifiers(df.limit(0), "id", "pattern_id", "variables").count() == 0


# 6 -------------------------------------------------------------------------------------------------------------------


def test_scores_on_odd_input(spark):
    rows = [(1, 1, "Host lost, HOST é1"), (2, 1, "lost"), (3, 1, None), (4, 1, ""), (5, None, "x"), (6, None, "x y"), (7, 2, "only")]
    df = spark.createDataFrame(rows, "id bigint, g bigint, t string").withColumn("term", F.lit("z"))
    got = {(r["key"], r["term"]): r for r in terms.term_scores(df, "id", "g", "t", float("inf"), 0.0, "plain").collect()}
    assert got[1, "host"]["uses"] == 2 and got[1, "host"]["n_records"] == 4 and got[1, "é1"]["n_with_term"] == 1
    assert got[1, "lost"]["score"] == round(np.log(4 / 2), 6)
    assert got[5, "x"]["score"] == 0.0 and got[6, "y"]["n_records"] == 2
    best = terms.most_characteristic(terms.term_scores(df, "id", "g", "t").where("n_with_term > 1"))
    assert {r["key"] for r in best.collect()} >= {1, 2}
    assert terms.term_scores(df.limit(0), "id", "g", "t").count() == 0


def test_saturation_and_length(spark):
    df = spark.createDataFrame([(1, 1, "a a a a b"), (2, 1, "a b"), (3, 1, "c")], "id bigint, g bigint, t string")
    s = {(r["key"], r["term"]): r["score"] for r in terms.term_scores(df, "id", "g", "t").collect()}
    assert s[1, "b"] < s[2, "b"] and s[1, "a"] < 4 * s[2, "a"]


# 8 -------------------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = words.split_words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words.split_words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


@pytest.mark.parametrize("size", [10**9, 9000])
def test_leaks_equal_brute_force(spark, size):
    r = random.Random(13)
    vocab = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([5, 12, 30, 60])))) for i in range(40)] + [(99, ""), (98, None), (1, "the " * 20)]
    docs = []
    for i in range(400):
        text = r.choices(vocab, k=r.choice([0, 3, 12, 13, 24, 40, 200]))
        if r.random() < 0.5:
            w = (r.choice(items)[1] or "").split()
            a = r.randrange(max(1, len(w) - 10))
            at = r.randrange(len(text) + 1)
            text[at:at] = [x.upper() + r.choice(["", ",", "\n"]) for x in w[a : a + r.choice([11, 12, 13, 30])]]
        docs.append((i, " ".join(text)))
    docs += [(500, None), (501, ""), (502, "the " * 3000), (3, docs[7][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    q = spark.createDataFrame(items, "item_id bigint, text string")
    got = leaks.leaks(d, "doc_id", "text", q, "item_id", "text", index_bytes=size).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute_leaks(docs, items)
    assert leaks.leaks(d, "doc_id", "text", q.limit(0), "item_id", "text").count() == 0
    assert leaks.leaks(d.limit(0), "doc_id", "text", q, "item_id", "text").count() == 0


def test_search_discards_passages():
    items = [(i, " ".join(f"i{i}w{k}" for k in range(40))) for i in range(40)]
    index = leaks.build_index(items)
    flat, starts = words.batch_words([items[3][1], "nothing of it " * 50, items[7][1][: len(items[7][1]) // 4]])
    at, item = leaks.retrieve(index, index.coded(flat, starts)[1], starts, 12)
    assert set(item.tolist()) == {3} and (at < 40).all()


@pytest.mark.parametrize("entries", [50, 2_000_000])
def test_search_loses_nothing(monkeypatch, entries):
    """Every passage and item whose score, summed word by word, reaches the threshold is retrieved, and no other."""
    monkeypatch.setattr(leaks, "_ENTRIES", entries)
    r = random.Random(31)
    vocab, often = [f"w{i}" for i in range(9)], [0.5**i for i in range(9)]
    items = [(i, " ".join(r.choices(vocab, often, k=r.choice([12, 30, 60])))) for i in range(150)]
    index = leaks.build_index(items)
    texts = [" ".join(r.choices(vocab, often, k=90)) for _ in range(60)]
    texts += [" ".join(r.choices(vocab, often, k=9) + items[i][1].split()[:14]) for i in range(0, 150, 7)]
    flat, starts = words.batch_words(texts)
    found = index.coded(flat, starts)[1]
    weight = np.zeros((len(index.top), 150))
    term = np.repeat(index.keys // index.blocks, np.diff(index.first))
    weight[term, index.items] = index.impact
    want = set()
    for t in range(len(texts)):
        n_words = starts[t + 1] - starts[t]
        for k in range(max(1, -(-(n_words - 12) // 12))):
            a = starts[t] + 12 * k
            score = weight[found[a : min(a + 24, starts[t + 1]) - 2]].sum(0)
            want |= {(int(a), int(i)) for i in np.flatnonzero(score >= 1 - 1e-4)}
    at, item = leaks.retrieve(index, found, starts, 12)
    got = list(zip(at.tolist(), item.tolist()))
    assert len(got) == len(set(got)) and set(got) == want and want


def test_index_is_as_small_as_stated():
    r = random.Random(37)
    vocab = ["".join(r.choices("abcdefghij", k=r.choice([2, 4, 7, 9]))) for _ in range(30_000)]
    items = [(i, " ".join(r.choices(vocab, k=80))) for i in range(4000)]
    assert leaks.build_index(items).nbytes <= leaks.BYTES_PER_CHAR * sum(len(t) for _, t in items)


# 9 -------------------------------------------------------------------------------------------------------------------


def brute_apportion(weights, caps, seats):
    out = [0] * len(weights)
    for _ in range(seats):
        live = [i for i in range(len(weights)) if out[i] < caps[i] and weights[i] > 0]
        if not live:
            break
        i = max(live, key=lambda i: (weights[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def test_apportion():
    r = random.Random(17)
    for _ in range(300):
        n = r.randrange(1, 8)
        weights = [r.choice([0.0, 0.1, 0.2, 0.5, 1.0, r.random()]) for _ in range(n)]
        caps = [r.choice([0, 1, 5, 100, 1000]) for _ in range(n)]
        seats = r.randrange(0, 300)
        assert apportion(weights, caps, seats) == brute_apportion(weights, caps, seats)
    assert sum(apportion([0.3, 0.7], [10**12, 10**12], 10**11)) == 10**11


def mixture(spark, docs, targets, **k):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumns({c: F.lit(0) for c in ("shard", "block", "tokens", "at", "s")})
    return Mixture(d, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **k)


def test_mixture(spark):
    r = random.Random(19)
    docs = [(i, " ".join(r.choices(["log", "line", "error", "host"], k=r.choice([0, 5, 60, 900]))), r.choice(["a", "A ", "a", "b-c", "B_C", "rare", None, "other"])) for i in range(900)]
    docs += [(-1, None, "a"), (-2, "", "b_c"), (5, "again", "rare")]
    targets = [("a", 0.5, 1), ("b_c", 0.3, 3), ("rare", 0.15, 2), ("absent", 0.05, 4)]
    m = mixture(spark, docs, targets, block=64, shard_rows=200, total_tokens=60_000)
    pieces = m.pieces().toPandas()
    shares = {x["source"]: x for x in m.shares().collect()}
    assert m.shards > 1 and pieces.equals(mixture(spark, docs, targets, block=64, shard_rows=200, total_tokens=60_000).pieces().toPandas())
    assert shares["absent"]["tokens"] == 0 and shares["absent"]["available_tokens"] == 0
    for name, _, repeats in targets:
        s = shares[name]
        assert s["most_uses"] <= repeats
        assert s["tokens"] == int((pieces[pieces.source == name].n_tokens * pieces[pieces.source == name].uses).sum())
    # no token of a document is in two pieces, and full blocks hold as many tokens as they should
    whole = pieces.groupby(["source", "shard", "block"]).n_tokens.sum()
    assert whole.max() == 64
    for _, p in pieces.sort_values("from_token").groupby(["doc_id", "source"]):
        spans = list(zip(p.from_token, p.from_token + p.n_tokens))
        assert all(b[0] >= a[1] for a, b in pairwise(spans))
    assert abs(shares["a"]["share_reached"] / shares["b_c"]["share_reached"] - 5 / 3) < 0.1


def test_mixture_of_little(spark):
    assert mixture(spark, [], [("a", 1.0, 1)]).pieces().count() == 0
    assert mixture(spark, [(1, "x y", "a")], []).shares().count() == 0
    m = mixture(spark, [(1, "x y z", "a")], [("a", None, 1), ("a", 1.0, 3)], total_tokens=10**6)
    assert m.shares().first()["most_uses"] == 3


# 10 ------------------------------------------------------------------------------------------------------------------


def brute_share(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    seen, mark = set(), [False] * len(w)
    for i in range(len(w) - 7):
        g = tuple(w[i : i + 8])
        if g in seen:
            mark[i : i + 8] = [True] * 8
        seen.add(g)
    return len(w), sum(mark) / len(w) if w else 0.0


def test_repetition_equals_brute_force(spark):
    r = random.Random(23)
    docs = [(1, None), (2, ""), (3, "..."), (4, "a " * 15), (5, "a " * 16), (6, "a " * 50_000), (6, "Ab c\r\n" * 30)]
    for i in range(10, 250):
        w = r.choices([f"x{k}" for k in range(r.choice([3, 300]))], k=r.choice([7, 20, 80, 300]))
        if r.random() < 0.5:
            a = r.randrange(len(w))
            w[r.randrange(len(w)) :] = w[a : a + r.choice([7, 8, 9, 40])] * r.choice([1, 2, 5])
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("votes", F.lit("clash"))
    scored = repetition.repetition(df, "doc_id", "text")
    got = sorted((g["doc_id"], g["n_words"], round(g["word_share"], 9)) for g in scored.collect())
    assert got == sorted((d, n, round(s, 9)) for d, (n, s) in ((d, brute_share(t)) for d, t in docs))
    want = sorted(d for d, t in docs if brute_share(t)[0] >= 16 and brute_share(t)[1] >= 0.25)
    assert sorted(g["doc_id"] for g in repetition.repetitive(scored).collect()) == want
    assert repetition.repetition(df.limit(0), "doc_id", "text").count() == 0
    # the posterior selects: nothing that is sought is lost
    selected = {g["doc_id"] for g in scored.where("selected").collect()}
    assert selected >= set(want)


def test_without_posterior_nothing_is_found(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b c d e f g h " * 9), (2, "some other words " + " ".join(map(str, range(40))))], "doc_id bigint, text string")
    scored = repetition.repetition(df, "doc_id", "text")
    assert [r["doc_id"] for r in scored.where("selected").collect()] == [1]
    assert [r["doc_id"] for r in repetition.repetitive(scored).collect()] == [1]
    monkeypatch.setattr(repetition, "fit_votes", lambda patterns: {})
    monkeypatch.setattr(repetition, "fit_limit", lambda counts, posterior: 0.5)
    assert repetition.repetitive(repetition.repetition(df, "doc_id", "text")).count() == 0


def test_limit_keeps_what_is_sought():
    post = {(1, 0): 0.9, (0, 1): 0.4, (0, 0): 0.2}
    assert repetition.fit_limit([((1, 0), 5, 5), ((0, 1), 3, 1), ((0, 0), 9, 0)], post) == 0.4
    assert repetition.fit_limit([((0, 0), 9, 0)], post) == 0.5


def test_votes_are_fitted():
    """Of planted classes and rules of known accuracy, the posterior finds the class and gives the better rule weight."""
    r = random.Random(29)
    counts = {}
    truth = {}
    for _ in range(4000):
        bad = r.random() < 0.2
        votes = tuple((1 if bad else -1) * (1 if r.random() < a else -1) if r.random() < 0.9 else 0 for a in (0.95, 0.9, 0.9, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(bad)
    post = repetition.fit_votes(sorted(counts.items()))
    right = sum((post[v] > 0.5) == b for v, bs in truth.items() for b in bs) / 4000
    assert right > 0.95
    assert post[1, 0, 0, 0] > post[0, 0, 0, 1]
    assert repetition.fit_votes([]) == {}


def test_portions_keep_all_rows():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(6)), pa.array(["a" * 5, None, "b" * 30, "", "c" * 9, "d"])], names=["i", "t"])
    out = list(words.portions(iter([batch]), 1, 10))
    assert [r for b in out for r in b.column(0).to_pylist()] == list(range(6)) and len(out) > 2
    assert list(words.portions(iter([batch.slice(0, 0)]), 1)) == []
