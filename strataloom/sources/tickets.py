"""A ticket system behind an injected transport: paged search, and the changes that a plan asks for."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.formats import basic_credentials
from strataloom.operators import tags as tag_ops
from strataloom.operators.tickets import Marker, body, change_comment, document_text, facts, plan, ticket_map

#: Issues of a page, repeats of a refused request, seconds to wait if the answer names none.
PAGE, MOST_TRIES, WAIT = 50, 5, 5

#: ``send(method, path, headers, body) -> (status, headers, body)``
Send = Callable[[str, str, dict, Any], tuple[int, dict, Any]]


@dataclass
class TicketConfig:
    url: str
    project: str
    label: str
    kind: str = "cloud"
    issue_type: str = "Bug"

    def __post_init__(self) -> None:
        if self.kind not in ("cloud", "server"):
            raise ValueError("kind must be cloud or server")
        self.url = self.url.rstrip("/")

    @property
    def base(self) -> str:
        return f"{self.url}/rest/api/{3 if self.kind == 'cloud' else 2}"

    def authorization(self, user_variable: str = "TICKET_USER", token_variable: str = "TICKET_TOKEN") -> dict[str, str]:
        """The header made of two environment variables, both required."""
        user, token = os.environ.get(user_variable), os.environ.get(token_variable)
        if not user or not token:
            raise ValueError(f"{user_variable} and {token_variable} must be set")
        scheme = f"Basic {basic_credentials(user, token)}" if self.kind == "cloud" else f"Bearer {token}"
        return {"Authorization": scheme}


def http_send(method: str, path: str, headers: dict, body: Any) -> tuple[int, dict, Any]:
    """A transport over HTTP with JSON bodies; the body of a GET goes into the address."""
    data = None
    if body is not None and method == "GET":
        path += "?" + urllib.parse.urlencode(body)
    elif body is not None:
        data = json.dumps(body).encode()
    request = urllib.request.Request(path, data, headers | {"Content-Type": "application/json", "Accept": "application/json"}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:
            text = answer.read()
            return answer.status, dict(answer.headers), json.loads(text) if text.strip() else None
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), None


@dataclass
class Outcome:
    """What a sync did: keys created and updated, patterns left as they were, and those that failed with the reason."""

    created: list[str] = field(default_factory=list)
    updated: list[str] = field(default_factory=list)
    unchanged: int = 0
    failed: list[tuple[int, str]] = field(default_factory=list)

    def lines(self) -> list[str]:
        total = len(self.created) + len(self.updated) + self.unchanged + len(self.failed)
        head = f"Synced {total} patterns ({len(self.created)} created, {len(self.updated)} updated, {self.unchanged} unchanged, {len(self.failed)} failed)"
        return [head, *(f"  + Created: {k}" for k in self.created), *(f"  ~ Updated: {k}" for k in self.updated), *(f"  ! Failed: {i}: {e}" for i, e in self.failed)]


class TicketClient:
    def __init__(self, config: TicketConfig, send: Send, headers: dict | None = None, sleep=time.sleep):
        self.config, self.send, self.headers, self.sleep = config, send, headers or {}, sleep

    def request(self, method: str, path: str, body: Any = None) -> Any:
        """One request, repeated after the time that a 429 asks for."""
        for _ in range(MOST_TRIES + 1):
            status, headers, answer = self.send(method, self.config.base + path, self.headers, body)
            if status != 429:
                break
            self.sleep(float(headers.get("Retry-After", WAIT)))
        if status >= 300:
            raise RuntimeError(f"{method} {path}: status {status}")
        return answer

    def pages(self) -> Iterator[dict]:
        start = 0
        query = f'project = "{self.config.project}" AND labels = "{self.config.label}"'
        while True:
            got = self.request("GET", "/search", {"jql": query, "startAt": start, "maxResults": PAGE})
            yield from got["issues"]
            start += len(got["issues"])
            if not got["issues"] or start >= got.get("total", start):
                return

    def tickets(self, spark: SparkSession, marker: Marker = Marker()) -> DataFrame:
        """``key, summary, description``; descriptions that are documents come as text."""
        rows = [(i["key"], i["fields"].get("summary"), document_text(i["fields"].get("description"), marker)) for i in self.pages()]
        return spark.createDataFrame(rows, "key string, summary string, description string")

    def carry_out(self, planned: DataFrame, dry_run: bool = False) -> Outcome:
        """Carry out a plan joined with its bodies (``pattern_id, key, action, summary, description`` and, for updates,
        ``comment``), row by row from an iterator; ``dry_run`` sends nothing."""
        out = Outcome()
        text = lambda x: json.loads(x) if self.config.kind == "cloud" and (x or "").startswith("{") else x
        told = "comment" in planned.columns
        for r in planned.where("action <> 'unchanged'").toLocalIterator():
            try:
                if r["action"] == "create":
                    kind = {"project": {"key": self.config.project}, "issuetype": {"name": self.config.issue_type}, "labels": [self.config.label]}
                    fields = {"summary": r["summary"], "description": text(r["description"])} | kind
                    made = None if dry_run else self.request("POST", "/issue", {"fields": fields})
                    out.created.append((made or {}).get("key") or f"pattern {r['pattern_id']}")
                else:
                    if not dry_run:
                        self.request("PUT", f"/issue/{r['key']}", {"fields": {"description": text(r["description"])}})
                        note = text(r["comment"]) if told else "Occurrences changed; description updated."
                        self.request("POST", f"/issue/{r['key']}/comment", {"body": note})
                    out.updated.append(r["key"])
            except RuntimeError as e:
                out.failed.append((r["pattern_id"], str(e)))
        return out

    def apply(self, planned: DataFrame) -> list[tuple[int, str]]:
        """Carry out a plan; returns the patterns that failed, with the reason."""
        return self.carry_out(planned).failed

    def sync(
        self,
        model: dict[str, DataFrame],
        db: str,
        create: bool = True,
        anomalous: DataFrame | None = None,
        min_count: int | None = None,
        any_of: list[str] | None = None,
        none_of: list[str] | None = None,
        new_only: bool = False,
        dry_run: bool = False,
        marker: Marker = Marker(),
    ) -> Outcome:
        """Bring the tickets of store ``db`` up to its patterns with occurrences that pass all filters given."""
        spark = model["patterns"].sparkSession
        found = self.tickets(spark, marker)
        known = ticket_map(found, marker).where(F.col("db") == db).select("pattern_id")
        seen = model["patterns"].where("occurrence_count > 0")
        chosen = tag_ops.select_patterns(seen, model["tags"], anomalous, min_count, any_of, none_of, known if new_only else None)
        planned = plan(chosen, found, db, create, marker)
        due = planned.where("action <> 'unchanged'")
        about = facts(chosen.join(due.select(F.col("pattern_id").alias("_d")), F.col("id") == F.col("_d"), "left_semi"), model["file_groups"], model["occurrences"])
        written = body(about, db, self.config.kind, marker).join(about.select("pattern_id", "last_seen"), "pattern_id")
        at = F.lit(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
        ready = due.join(written, "pattern_id").withColumn(
            "comment", change_comment(F.col("noted"), F.col("occurrence_count"), F.col("last_seen"), at, self.config.kind)
        )
        out = self.carry_out(ready.orderBy(F.desc("occurrence_count"), "pattern_id"), dry_run)
        out.unchanged = planned.where("action = 'unchanged'").count()
        return out
