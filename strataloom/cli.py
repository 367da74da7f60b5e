"""Command line: ``python -m strataloom.cli COMMAND ...`` over a store folder."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import subprocess
import sys
import tempfile
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.formats import format_size
from strataloom.operators import compare, correlate, dedup, export, rank, search, tags, tickets
from strataloom.session import local_session
from strataloom.sources.config import Config, load
from strataloom.sources.logs import expand, valid_files
from strataloom.sources.tickets import TicketClient, TicketConfig, http_send
from strataloom.store import Store
from strataloom.streaming import pipeline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataloom")
    p.add_argument("-d", "--store")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict], filters: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for flag, how in options:
            c.add_argument(flag, **how)
        if filters:
            c.add_argument("--filter", action="append")
            c.add_argument("--group", action="append")
            c.add_argument("--tags-file")
        return c

    n, x, on = {"type": int}, {"type": float}, {"action": "store_true"}
    as_what = ("--format", {"choices": ["json", "text"], "default": "json"})
    group, gone = ("--group", {"action": "append"}), ("--tags-file", {})
    sync = ("--ticket-sync", on)
    command("process", ("files", {"nargs": "+"}), ("--group-name", {}), ("--threshold", x), sync)
    command("watch", ("files", {"nargs": "+"}), ("--checkpoint", {"required": True}), ("--threshold", x), ("--seconds", n), ("--alert", x), sync)
    command("search", ("query", {}), as_what)
    command("stats", as_what)
    command("report", ("--output", {"required": True}), ("--top", n), ("--samples", n), ("--bucket", {}), filters=True)
    command("export", ("--output", {"required": True}), ("--format", {"choices": ["json", "csv"], "default": "json"}), ("--top", n), ("--samples", n), filters=True)
    command("diff", ("before", {}), ("after", {}), as_what)
    command("dedup", ("--threshold", x), ("--mode", {"choices": ["structural", "semantic"], "default": "structural"}), group, as_what)
    command("anomalies", ("--top", n), ("--include-suppressed", on), as_what, filters=True)
    command("baseline", ("action", {"choices": ["save", "compare"]}), ("path", {}), as_what)
    command("check", ("--max-score", x), ("--max-new", n), ("--baseline", {}), ("--fail-on", {"action": "append"}), gone, group, as_what)
    command("correlate", ("--window", n), ("--min-count", n), ("--top", n), as_what)
    command("cluster", ("--min-shared", n), ("--top", n), ("--pattern-limit", n), group, as_what)
    command("compact")
    command("serve", ("--port", {"type": int, "default": 8080}))
    comma = {"type": lambda v: [t for t in v.split(",") if t]}
    command(
        "tickets", ("action", {"choices": ["status", "sync", "update"]}), ("--anomalies-only", on), ("--tags", comma), ("--exclude-tags", comma),
        ("--min-occurrences", n), ("--new-only", on), ("--dry-run", on),
    )
    return p


def spool(stream) -> str:
    """Standard input as a file."""
    with tempfile.NamedTemporaryFile(prefix="stdin-", suffix=".log", delete=False) as f:
        shutil.copyfileobj(stream, f)
    return f.name


def desktop_note(title: str, text: str) -> bool:
    """A notification by whatever the desktop offers; False if it offers nothing."""
    if tool := shutil.which("notify-send"):
        return subprocess.run([tool, title, text], check=False).returncode == 0
    if tool := shutil.which("osascript"):
        script = f"display notification {json.dumps(text)} with title {json.dumps(title)}"
        return subprocess.run([tool, "-e", script], check=False).returncode == 0
    return False


def show(df: DataFrame, out, how: str = "json") -> None:
    """Rows as JSON lines, or as text with a heading and tabs between the columns, a partition at a time."""
    if how == "text":
        print("\t".join(df.columns), file=out)
        plain = [F.coalesce((F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string")), F.lit("")) for c, t in df.dtypes]
        df = df.select(F.concat_ws("\t", *(F.regexp_replace(c, r"[\t\r\n]+", " ") for c in plain)))
    else:
        df = df.select(F.to_json(F.struct(*df.columns)))
    for r in df.toLocalIterator():
        print(r[0], file=out)


def sync_tickets(c: Config, store: Store, out, send=http_send, **how) -> int:
    """Tickets of the store's patterns, as the settings' section on tickets says; 1 if some failed."""
    if not c.tickets:
        print("warning: the settings have no section on tickets", file=sys.stderr)
        return 1
    t = TicketConfig(**c.tickets)
    result = TicketClient(t, send, t.authorization()).sync(store.model(), store.name, **how)
    print("\n".join(result.lines()), file=out)
    return 1 if result.failed else 0


def within(patterns: DataFrame, groups: DataFrame, names: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Patterns and file groups of the names given; all without names."""
    if not names:
        return patterns, groups
    kept = groups.where(F.col("name").isin(names))
    return patterns.join(kept.select(F.col("id").alias("_g")), F.col("file_group_id") == F.col("_g"), "left_semi"), kept


def run(argv: list[str], spark=None, out=None, send=http_send) -> int:
    a = parser().parse_args(argv)
    out = out or sys.stdout
    how = getattr(a, "format", "json")
    c: Config = load(
        store=a.store, threshold=getattr(a, "threshold", None) if a.command != "dedup" else None, top=getattr(a, "top", None),
        samples=getattr(a, "samples", None), window=getattr(a, "window", None), min_count=getattr(a, "min_count", None),
        min_shared=getattr(a, "min_shared", None),
        dedup_threshold=getattr(a, "threshold", None) if a.command == "dedup" else None,
    )
    spark = spark or local_session()
    store = Store(spark, c.store)
    if a.command in ("process", "watch"):
        spooled = None
        if a.files == ["-"]:
            spooled = spool(sys.stdin.buffer)
            a.files, a.group_name = [spooled], getattr(a, "group_name", None) or "stdin"
        good, warnings = valid_files([f for p in a.files for f in expand(p)])
        for w in warnings:
            print("warning: " + w, file=sys.stderr)
        if a.command == "process":
            pipeline.process(spark, store, ",".join(good), a.group_name, c.threshold, time.gmtime().tm_year)
            if spooled:
                os.remove(spooled)
            show(rank.summary(*(store.model()[k] for k in ("patterns", "log_sources"))), out)
            return sync_tickets(c, store, out, send) if a.ticket_sync else 0
        notify = None
        if a.alert is not None:

            def notify(found: DataFrame) -> None:
                for r in found.where(F.col("score") >= a.alert).collect():  # 10 rows at most
                    print(json.dumps(r.asDict()), file=out)
                    desktop_note("Log anomaly", f"{r['score']:.1f} {r['template'][:100]}")

        def tell(new: DataFrame) -> None:
            show(new, out)
            if a.ticket_sync:
                sync_tickets(c, store, out, send)

        q = pipeline.watch(spark, store, ",".join(good), a.checkpoint, None, c.threshold, time.gmtime().tm_year, alert=notify, tell=tell)
        q.awaitTermination(a.seconds)
        q.stop()
        pipeline.finish(store, c.threshold, time.gmtime().tm_year)
        return 0
    if a.command == "diff":
        sides = [Store(spark, p).model() for p in (a.before, a.after)]
        show(compare.in_order(compare.diff(*(compare.snapshot(m["patterns"], m["file_groups"]) for m in sides))), out, how)
        return 0
    if a.command == "compact":
        store.compact()
        return 0
    m = store.model()
    p, g, o, s = m["patterns"], m["file_groups"], m["occurrences"], m["log_sources"]
    gone = tags.suppressed(tags.read_tag_file(spark, a.tags_file)) if getattr(a, "tags_file", None) else None
    if a.command == "tickets":
        if a.action == "status":
            t = TicketConfig(**c.tickets) if c.tickets else None
            if t is None:
                return sync_tickets(c, store, out, send)
            found = TicketClient(t, send, t.authorization()).tickets(spark)
            show(tickets.status(p, found, store.name), out)
            return 0
        scores = compare.anomalies(p, g, o, s, None).select("pattern_id") if a.anomalies_only else None
        return sync_tickets(
            c, store, out, send, create=a.action == "sync", anomalous=scores, min_count=a.min_occurrences, any_of=a.tags,
            none_of=a.exclude_tags, new_only=a.new_only, dry_run=a.dry_run,
        )
    if a.command == "search":
        show(search.search(p, a.query), out, how)
    elif a.command == "stats":
        show(rank.summary(p, s), out, how)
        show(rank.by_group(g, p, False).orderBy("group"), out, how)
        names = g.select(F.col("id").alias("_g"), F.col("name").alias("group"))
        named = s.join(names, F.col("file_group_id") == F.col("_g"), "left").select("group", "file_path", "last_processed_position")
        for r in named.orderBy("group", "file_path").toLocalIterator():
            size = os.path.getsize(r["file_path"]) if os.path.isfile(r["file_path"]) else 0
            done = f"{100 * r['last_processed_position'] / size:.1f}%" if size else "N/A"
            print(json.dumps(r.asDict() | {"processed": done}) if how == "json" else "\t".join([*map(str, r), done]), file=out)
        total = store.size()
        print(json.dumps({"store": store.path, "bytes": total, "size": format_size(total)}) if how == "json" else f"{store.path}\t{format_size(total)}", file=out)
    elif a.command in ("report", "export"):
        if a.filter:
            p = p.where(rank.like_any(F.col("template"), a.filter))
        p, g = within(p, g, a.group)
        if a.command == "report":
            page = rank.report(p, g, o, s, m["tags"], c.top, c.samples, a.bucket or c.bucket, gone)
            timed = not o.where("entry_timestamp is not null").isEmpty()
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(export.render_page(page, "Log pattern Report", timed))
        else:
            if a.format == "csv":
                export.write_csv(export.export_rows(p, g, o, s, gone, c.top, c.samples), a.output)
            else:
                export.write_array(export.export_nested(p, g, o, s, gone, c.top, c.samples), a.output)
    elif a.command == "dedup":
        p, g = within(p, g, a.group)
        found = dedup.duplicate_classes(p, a.mode, c.dedup_threshold)
        about = p.select(F.col("id").alias("_i"), "occurrence_count", correlate.preview(F.col("template")).alias("template"))
        found = found.join(about, F.col("id") == F.col("_i")).drop("_i")
        show(found.orderBy("component", F.desc("occurrence_count"), "id"), out, how)
    elif a.command == "anomalies":
        p, g = within(p, g, a.group)
        if a.filter:
            p = p.where(rank.like_any(F.col("template"), a.filter))
        show(compare.anomalies(p, g, o, s, a.top or 50, None if a.include_suppressed else gone), out, how)
    elif a.command == "baseline":
        now = compare.snapshot(p, g)
        if a.action == "save":
            export.save_baseline(now, a.path)
        else:
            show(compare.in_order(compare.diff(export.read_baseline(spark, a.path), now)), out, how)
    elif a.command == "check":
        p, g = within(p, g, a.group)
        d = None
        if a.baseline:
            base = export.read_baseline(spark, a.baseline)
            d = compare.diff(base.where(F.col("group").isin(a.group)) if a.group else base, compare.snapshot(p, g))
        max_score = a.max_score if a.max_score is not None else c.max_anomaly_score
        max_new = a.max_new if a.max_new is not None else c.max_new_patterns
        scores = compare.anomalies(p, g, o, s, None, gone)
        shown = p if gone is None else p.join(gone.select(F.col("pattern_id").alias("_x")), F.col("id") == F.col("_x"), "left_anti")
        result = compare.gate(scores, d, shown, max_score, max_new, tuple(a.fail_on or c.needles)).collect()  # a row per check
        for r in result:
            print(json.dumps(r.asDict()) if how == "json" else f"{'PASS' if r['passed'] else 'FAIL'}\t{r['name']}\t{r['actual']}\t{r['threshold']}", file=out)
        return 0 if all(r["passed"] for r in result) else 1
    elif a.command == "correlate":
        show(correlate.described(correlate.correlations(o, p, c.window, c.min_count, a.top or 20), p, g), out, how)
    elif a.command == "cluster":
        p, g = within(p, g, a.group)
        show(correlate.described_clusters(correlate.clusters(o, p, c.min_shared, a.top or 20, a.pattern_limit), p), out, how)
    elif a.command == "serve":
        from strataloom.serve import server

        server(store, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
