"""Sources, store, stream and command line."""

import io
import json
import os
import threading
import urllib.request

import pytest

from strataloom import cli
from strataloom.serve import server
from strataloom.sources import config, logs
from strataloom.store import Store
from strataloom.streaming import pipeline
from tests.test_operators import lines


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)
    return str(path)


def test_lines_with_offsets(spark, tmp_path):
    data = b"one\r\ntwo\rx\n\n\xff\xfe\nlast" + b"a" * 70_000
    (tmp_path / "a.log").write_bytes(data)
    want, at = [], 0
    for raw in data.split(b"\n"):
        after = min(at + len(raw) + 1, len(data))
        want.append((at, after, logs.clean_line(raw)))
        at = after
    for split in (1 << 20, 7, 1):
        if split == 1:  # one task per byte is only for the head
            got = [tuple(r) for p in logs.ranges(str(tmp_path / "a.log"), 0, 12, 1) for b in logs.read_range(p) for r in zip(*(c.to_pylist() for c in b.columns[1:]))]
            assert got == [w for w in want if w[0] < 12]
            continue
        df = logs.read_lines(spark, str(tmp_path / "*.log"), split=split if split > 7 else 4096)
        assert sorted((r["byte_offset"], r["next_offset"], r["line"]) for r in df.collect()) == want
    assert want[0][2] == "one" and want[1][2] == "two\rx" and want[3][2] == "" and len(want[4][2]) == logs.MAX_LINE
    resumed = logs.read_lines(spark, str(tmp_path / "a.log"), {str(tmp_path / "a.log"): 5})
    assert sorted(r["byte_offset"] for r in resumed.collect()) == [w[0] for w in want if w[0] >= 5]


def test_long_lines_are_kept_whole(spark, tmp_path):
    """By the pipeline, up to their last token; a cut line ends at a character."""
    assert logs.clean_line("é".encode() * 40_000 + b"a") == "é" * 32_768
    assert logs.clean_line(b"a" + "é".encode() * 40_000) == "a" + "é" * 32_767 and logs.clean_line(b"\xff" * 70_000) == ""
    long = "2026-01-01 00:00:00 " + "word " * 30_000 + "last=1234567"
    store = Store(spark, str(tmp_path / "store"))
    pipeline.process(spark, store, write(tmp_path / "a.log", long + "\n"))
    assert store.model()["patterns"].first()["template"].count("word") == 30_000
    assert store.model()["occurrences"].first()["variables"].endswith("last=1234567")


def test_valid_files(tmp_path):
    good = write(tmp_path / "a.log", "x\n")
    empty = write(tmp_path / "b.log", "")
    files, warnings = logs.valid_files([good, empty, str(tmp_path), str(tmp_path / "none")])
    assert files == [good] and len(warnings) == 3
    with pytest.raises(ValueError, match="no readable"):
        logs.valid_files([empty])


def test_config(tmp_path):
    write(tmp_path / config.FILE_NAME, 'threshold = 0.7\ntop = 9\nneedles = ["x"]\nunknown = 1\n')
    c = config.load(tmp_path, top=3, samples=None)
    assert (c.threshold, c.top, c.samples, c.needles) == (0.7, 3, 5, ["x"])
    with pytest.raises(ValueError, match="threshold"):
        config.load(tmp_path, threshold=2.0)


def view(store):
    m = store.model()
    occ = sorted((r["log_source_id"], r["byte_offset"], r["entry_timestamp"], r["variables"]) for r in m["occurrences"].collect())
    return occ, sorted((r["template"], r["occurrence_count"]) for r in m["patterns"].collect())


def test_stream_equals_batch(spark, tmp_path):
    text = "\n".join(lines(60)) + "\n"
    path = write(tmp_path / "app.log", text)
    whole = Store(spark, str(tmp_path / "whole"))
    pipeline.process(spark, whole, path)
    assert whole.model()["occurrences"].count() == 69
    os.remove(path)
    write(path, "")
    parts = Store(spark, str(tmp_path / "parts"))
    for i, piece in enumerate((text[:900], text[900:2000], text[2000:])):
        write(path, piece, "a")
        q = pipeline.watch(spark, parts, path, str(tmp_path / "cp"), trigger={"availableNow": True})
        q.awaitTermination(120)
        assert q.exception() is None, i
    pipeline.finish(parts)
    assert view(parts) == view(whole)


def test_rotation_and_repeated_step(spark, tmp_path):
    path = write(tmp_path / "r.log", "2026-01-15 08:00:00 a one\n2026-01-15 08:00:01 a two\n")
    store = Store(spark, str(tmp_path / "s"))
    run = lambda: pipeline.watch(spark, store, path, str(tmp_path / "cp"), trigger={"availableNow": True}).awaitTermination(120)
    run()
    write(path, "2026-01-16 08:00:00 a new\n")  # shorter: the file was replaced
    run()
    pipeline.finish(store)
    assert sorted(r["byte_offset"] for r in store.model()["occurrences"].collect()) == [0, 0, 26]
    before = view(store)
    version = store.next_version() - 1
    none = store.read("open_lines", 0)
    pipeline.step(store, none, version, True)  # done again
    assert view(store) == before


def test_standard_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO("\n".join(lines(20)).encode())))
    out = io.StringIO()
    assert cli.run(["-d", str(tmp_path / "s"), "process", "-"], spark, out) == 0
    assert json.loads(out.getvalue())["n_occurrences"] == 23
    assert [g["name"] for g in Store(spark, str(tmp_path / "s")).model()["file_groups"].collect()] == ["stdin"]


def test_command_line_and_server(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name in ("app.log", "app.log.1", "other-2026-01-01.log"):
        write(folder / name, "\n".join(lines(30)) + "\n")
    store = str(tmp_path / "store")

    def run(*args):
        out = io.StringIO()
        code = cli.run(["-d", store, *args], spark, out)
        return code, [json.loads(x) for x in out.getvalue().splitlines()]

    code, rows = run("process", str(folder / "*"))
    assert code == 0 and rows[0]["n_sources"] == 3
    total = rows[0]["n_occurrences"]
    assert run("process", str(folder / "*"))[1][0]["n_occurrences"] == total  # nothing new
    assert {g["group"] for g in run("stats")[1] if "group" in g} == {"app.log", "other.log"}
    assert run("search", "processing failed")[1]
    assert run("baseline", "save", str(tmp_path / "base"))[0] == 0
    assert run("baseline", "compare", str(tmp_path / "base"))[1] == []
    assert run("check", "--fail-on", "Operation")[0] == 1
    assert run("check", "--baseline", str(tmp_path / "base"), "--max-new", "0", "--max-score", "100")[0] == 0
    assert run("diff", store, store)[1] == []
    for command in (["dedup"], ["dedup", "--mode", "semantic"], ["anomalies"], ["correlate"], ["cluster"]):
        assert run(*command)[0] == 0
    before = rows[0]["n_occurrences"]
    assert run("compact")[0] == 0
    assert run("process", str(folder / "*"))[1][0]["n_occurrences"] == before  # counted from the table written whole
    sizes = [r for r in run("stats")[1] if "bytes" in r or "processed" in r]
    assert [r["processed"] for r in sizes[:-1]] == ["100.0%"] * 3 and sizes[-1]["bytes"] > 0
    some = Store(spark, store).model()["patterns"].where("template like '%Operation%'").first()["id"]
    (tmp_path / "tags.json").write_text(json.dumps({str(p["id"]): ["suppress"] for p in Store(spark, store).model()["patterns"].where("template like '%Operation%'").collect()}))
    assert some and run("check", "--fail-on", "Operation", "--tags-file", str(tmp_path / "tags.json"))[0] == 0
    assert run("check", "--fail-on", "Operation", "--group", "other.log")[0] == 1
    assert {r["group"] for r in run("anomalies", "--group", "app.log")[1]} <= {"app.log"}
    assert run("anomalies", "--filter", "no such text")[1] == []
    assert run("dedup", "--group", "nothing")[1] == []
    out = io.StringIO()
    assert cli.run(["-d", store, "stats", "--format", "text"], spark, out) == 0 and out.getvalue().startswith("n_patterns\t")
    run("report", "--output", str(tmp_path / "r.html"))
    assert "const DATA" in (tmp_path / "r.html").read_text()
    run("export", "--format", "csv", "--output", str(tmp_path / "csv"), "--filter", "operation")
    assert run("export", "--output", str(tmp_path / "json"))[0] == 0
    assert {"id", "group", "template", "occurrence_count", "samples"} == set(json.loads((tmp_path / "json").read_text())[0])

    http = server(Store(spark, store), 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_address[1]}"
    get = lambda p: json.load(urllib.request.urlopen(url + p))
    try:
        assert get("/api/summary")["n_sources"] == 3
        found = get("/api/patterns?top=2&group=app.log")["patterns"]
        assert len(found) == 2
        body = json.dumps({"pattern_id": found[0]["pattern_id"], "tags": ["x"]}).encode()
        urllib.request.urlopen(urllib.request.Request(url + "/api/tags", body))
        assert ["x"] in [p["tags"] for p in get("/api/patterns")["patterns"] if p.get("tags")]
        assert [p["tags"] for p in get("/api/patterns?tag=x&sort=template")["patterns"]] == [["x"]]
        assert isinstance(get("/api/anomalies"), list)
        exported = get("/api/export?format=json")["patterns"]
        assert {s["source"] for p in exported for s in p.get("samples", [])} <= {str(folder / n) for n in ("app.log", "app.log.1", "other-2026-01-01.log")}
        assert any(p.get("samples") for p in exported) and len(get("/api/summary?sources=2")["sources"]) == 2
        with pytest.raises(urllib.error.HTTPError):
            get("/api/export?format=csv")
        assert b"<html" in urllib.request.urlopen(url + "/").read()
    finally:
        http.shutdown()
