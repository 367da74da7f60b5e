import pytest
from pyspark.sql import functions as F

from strataloom.functions.formats import format_size, thousands
from strataloom.operators import tickets
from strataloom.sources.tickets import TicketClient, TicketConfig


def test_formats():
    assert [format_size(n) for n in (0, 1023, 1024, 1536, 5 * 1024**2, 3 * 1024**4)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3072.0 GB"]
    assert thousands(1234567) == "1,234,567"


def test_config(monkeypatch):
    c = TicketConfig("https://tickets.example/", "LOG", "patterns")
    assert c.base == "https://tickets.example/rest/api/3"
    monkeypatch.delenv("TICKET_USER", raising=False)
    with pytest.raises(ValueError, match="must be set"):
        c.authorization()
    monkeypatch.setenv("TICKET_USER", "u")
    monkeypatch.setenv("TICKET_TOKEN", "t")
    assert c.authorization() == {"Authorization": "Basic dTp0"}
    assert TicketConfig("x", "L", "p", "server").authorization() == {"Authorization": "Bearer t"}
    with pytest.raises(ValueError, match="kind"):
        TicketConfig("x", "L", "p", "other")


def test_client_against_a_fake(spark):
    issues = [{"key": f"L-{i}", "fields": {"summary": "s", "description": f"main;{i};5"}} for i in range(70)]
    sent, waited, refuse = [], [], [True]

    def send(method, path, headers, body):
        if refuse[0]:
            refuse[0] = False
            return 429, {"Retry-After": "2"}, None
        sent.append((method, path.rsplit("/rest/api/3", 1)[1]))
        if path.endswith("/search"):
            return 200, {}, {"issues": issues[body["startAt"] : body["startAt"] + body["maxResults"]], "total": 70}
        return (500, {}, None) if path.endswith("L-7") else (201, {}, {})

    client = TicketClient(TicketConfig("https://x", "LOG", "p"), send, sleep=waited.append)
    found = client.tickets(spark)
    assert found.count() == 70 and waited == [2.0]
    p = spark.createDataFrame([(5, 5), (6, 9), (7, 1), (100, 3)], "id bigint, occurrence_count bigint")
    body = spark.createDataFrame([(i, "s", "d") for i in (5, 6, 7, 100)], "pattern_id bigint, summary string, description string")
    failed = client.apply(tickets.plan(p, found, "main").join(body, "pattern_id").orderBy("pattern_id"))
    assert [f[0] for f in failed] == [7]
    assert sent[2:] == [("PUT", "/issue/L-6"), ("POST", "/issue/L-6/comment"), ("PUT", "/issue/L-7"), ("POST", "/issue")]


def model(spark):
    return {
        "patterns": spark.createDataFrame([(1, 1, "a <*>\nb", 1500), (2, 1, "c", 7), (3, 1, "d", 4), (4, 1, "e", 0)], "id bigint, file_group_id bigint, template string, occurrence_count bigint"),
        "file_groups": spark.createDataFrame([(1, "app.log")], "id bigint, name string"),
        "occurrences": spark.createDataFrame([(1, 9, 1, 0, 1768464000, "x\ty"), (2, 9, 1, 5, 1768464060, "z"), (3, 9, 2, 9, None, "")], "id bigint, log_source_id bigint, pattern_id bigint, byte_offset bigint, entry_timestamp bigint, variables string"),
        "tags": spark.createDataFrame([(2, "critical"), (3, "noise")], "pattern_id bigint, tag string"),
    }


@pytest.mark.parametrize("kind", ["server", "cloud"])
def test_sync_against_a_fake(spark, kind):
    issues, notes = {}, []

    def send(method, path, headers, body):
        if path.endswith("/search"):
            rows = [{"key": k, "fields": v} for k, v in sorted(issues.items())]
            return 200, {}, {"issues": rows[body["startAt"] :], "total": len(rows)}
        if path.endswith("/issue"):
            key = f"L-{len(issues) + 1}"
            issues[key] = body["fields"]
            return 201, {}, {"key": key}
        if path.endswith("/comment"):
            notes.append(body["body"])
        else:
            issues[path.rsplit("/", 1)[1]].update(body["fields"])
        return 204, {}, None

    client, m = TicketClient(TicketConfig("https://x", "LOG", "p", kind), send), model(spark)
    dry = client.sync(m, "main", dry_run=True)
    assert len(dry.created) == 3 and not issues
    made = client.sync(m, "main", none_of=["noise"])
    assert made.created == ["L-1", "L-2"] and made.lines()[0] == "Synced 2 patterns (2 created, 0 updated, 0 unchanged, 0 failed)"
    text = tickets.document_text(issues["L-1"]["description"])
    for part in ("a <*>\nb", "1,500", "2026-01-15 08:00:00 UTC", "2026-01-15 08:01:00 UTC", "app.log", "x | y\nz", "pattern:db=main;pattern_id=1;occurrences=1500"):
        assert part in text
    assert isinstance(issues["L-1"]["description"], dict) == (kind == "cloud")
    assert client.sync(m, "main", any_of=["critical"]).unchanged == 1
    m["patterns"] = m["patterns"].withColumn("occurrence_count", F.when(F.col("id") == 1, 1400).otherwise(F.col("occurrence_count")))
    again = client.sync(m, "main", create=False)
    assert again.updated == ["L-1"] and again.unchanged == 1 and not again.created
    assert "1,500 -> 1,400 (-100)" in tickets.document_text(notes[0]) and "2026-01-15 08:01:00 UTC" in tickets.document_text(notes[0])
    assert client.sync(m, "main", new_only=True, min_count=5).created == []
    assert tuple(tickets.status(m["patterns"], client.tickets(spark), "main").first()) == (3, 2, 1, 0)
    other = tickets.Marker("other-fence", "own:")
    assert tickets.ticket_map(client.tickets(spark), other).count() == 0


def test_summary_is_cut_by_bytes(spark):
    df = spark.createDataFrame([("x" * 300,), ("é" * 200,), ("short",), ("😀" * 80,)], "t string")
    got = [r[0] for r in df.select(tickets.summary_line(F.col("t"))).collect()]
    assert [len(x.encode()) <= 255 for x in got] == [True] * 4
    assert got[0] == "Log pattern: " + "x" * 239 + "..." and got[1].endswith("é...") and got[2] == "Log pattern: short" and got[3].endswith("😀...")
