"""A small HTTP view of a store: summary, patterns, anomalies, tags, export."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import compare, rank, tags
from strataloom.store import Store

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Log patterns</title>
<style>body{font:14px sans-serif;margin:2em}th{cursor:pointer;text-align:left}td,th{padding:.3em .8em;border-bottom:1px solid #ddd;vertical-align:top}
.off{opacity:.4}pre{margin:0;white-space:pre-wrap}input{margin-right:.6em}svg{stroke:#36c;fill:none}</style></head><body><h1>Log patterns</h1>
<p id="summary"></p><form id="form"><input id="filter" placeholder="text"><input id="group" placeholder="group"><input id="tag" placeholder="tag">
<label><input type="checkbox" id="hide">hide suppressed</label><button>show</button></form><table><thead><tr id="head"></tr></thead><tbody id="body"></tbody></table>
<h2>Anomalies</h2><ul id="odd"></ul><script>
const at = id => document.getElementById(id), get = u => fetch(u).then(r => r.json());
const COLUMNS = [["occurrence_count", "Count"], ["group", "Group"], ["template", "Template"], ["trend", "Trend"], ["tags", "Tags"]];
let shown = [], by = "occurrence_count", down = true;
const value = (p, k) => k === "trend" ? (p.trend || []).length : k === "tags" ? (p.tags || []).join(", ") : p[k];
function line(points) {
  const n = points.map(x => x.n), top = Math.max(1, ...n), step = 100 / Math.max(1, n.length - 1);
  const svg = document.createElementNS("http://www.w3.org/2000/svg", "svg"), path = document.createElementNS(svg.namespaceURI, "polyline");
  svg.setAttribute("width", 100); svg.setAttribute("height", 20);
  path.setAttribute("points", n.map((v, i) => (i * step) + "," + (20 - 18 * v / top)).join(" "));
  svg.appendChild(path); return svg;
}
async function setTags(p, tags) {
  await fetch("/api/tags", {method: "POST", body: JSON.stringify({pattern_id: p.pattern_id, tags})});
  p.tags = tags; p.suppressed = tags.some(t => t === "suppress" || t === "ignore"); draw();
}
function button(text, act) { const b = document.createElement("button"); b.textContent = text; b.onclick = act; return b; }
function draw() {
  at("head").replaceChildren(...COLUMNS.map(([k, name]) => { const h = document.createElement("th");
    h.textContent = name + (k === by ? (down ? " \u2193" : " \u2191") : ""); h.onclick = () => { down = k === by ? !down : true; by = k; draw(); }; return h; }));
  const order = (a, b) => { const x = value(a, by), y = value(b, by); return (x < y ? -1 : x > y ? 1 : 0) * (down ? -1 : 1); };
  at("body").replaceChildren(...[...shown].sort(order).map(p => {
    const r = document.createElement("tr"); if (p.suppressed) r.className = "off";
    for (const [k] of COLUMNS) { const c = r.insertCell();
      if (k === "trend") c.appendChild(line(p.trend || []));
      else { const t = document.createElement("pre"); t.textContent = value(p, k); c.appendChild(t); }
      if (k === "template") for (const s of p.samples || []) { const t = document.createElement("pre"); t.textContent = s.source + ": " + s.text; t.className = "off"; c.appendChild(t); } }
    const tags = p.tags || [], c = r.insertCell();
    c.append(button("tags", () => { const t = prompt("Tags, between commas", tags.join(", ")); if (t !== null) setTags(p, t.split(",").map(x => x.trim()).filter(x => x)); }),
      button(p.suppressed ? "show" : "suppress", () => setTags(p, p.suppressed ? tags.filter(t => t !== "suppress" && t !== "ignore") : [...tags, "suppress"])));
    return r; }));
}
async function load() {
  const q = new URLSearchParams({top: 500, hide_suppressed: at("hide").checked ? 1 : 0});
  for (const k of ["filter", "group", "tag"]) if (at(k).value) q.set(k, at(k).value);
  shown = (await get("/api/patterns?" + q)).patterns; draw();
}
at("form").onsubmit = e => { e.preventDefault(); load(); };
get("/api/summary").then(x => { at("summary").textContent = x.n_patterns + " patterns, " + x.n_occurrences + " occurrences, " + x.n_sources + " files"; });
get("/api/anomalies").then(x => at("odd").replaceChildren(...x.map(a => { const i = document.createElement("li");
  i.textContent = a.score.toFixed(1) + " " + a.group + ": " + a.template + " (" + (a.reasons || []).join(", ") + ")"; return i; })));
load();
</script></body></html>"""


def rows(df: DataFrame) -> list[dict]:
    """Rows of a result that its query bounds."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).collect()]


class Api:
    def __init__(self, store: Store):
        self.store, self.lock = store, Lock()

    def get(self, path: str, args: dict[str, str]) -> tuple[int, str, str]:
        if path == "/":
            return 200, "text/html", PAGE
        m = self.store.model()
        if path == "/api/summary":
            one = rows(rank.summary(m["patterns"], m["log_sources"]))[0]
            one["groups"] = rows(rank.by_group(m["file_groups"], m["patterns"], True))
            # as many file names as asked for, first by name; n_sources counts all
            names = m["log_sources"].select("file_path").orderBy("file_path").limit(int(args.get("sources", 1000)))
            one["sources"] = [r["file_path"] for r in names.collect()]
            span = rows(rank.time_range(m["occurrences"]))[0]
            one["time_range"] = span if span else None
            return 200, "application/json", json.dumps(one)
        if path == "/api/patterns":
            split = lambda k: [x.strip() for x in args.get(k, "").split(",") if x.strip()] or None
            p = m["patterns"]
            if split("filter"):
                p = p.where(rank.like_any(F.col("template"), split("filter")))
            g = m["file_groups"]
            if split("group"):
                g = g.where(F.col("name").isin(split("group")))
            hidden = tags.suppressed(m["tags"])
            report = rank.report(
                p, g, m["occurrences"], m["log_sources"], m["tags"], int(args.get("top", 100)), 5, suppressed=hidden
            )
            if args.get("tag"):
                report = report.where(F.array_contains("tags", args["tag"]))
            if args.get("hide_suppressed") == "1":
                report = report.where("not suppressed")
            trend = F.desc(F.size(F.coalesce("trend", F.array())))
            order = {"template": ["template"], "group": ["group", F.desc("occurrence_count")], "trend": [trend], "count": [F.desc("occurrence_count")]}.get(args.get("sort", ""))
            if order:
                report = report.orderBy(*order, "pattern_id")
            timed = not m["occurrences"].where("entry_timestamp is not null").isEmpty()
            return 200, "application/json", json.dumps({"has_timestamps": timed, "patterns": rows(report)})
        if path == "/api/anomalies":
            found = compare.anomalies(m["patterns"], m["file_groups"], m["occurrences"], m["log_sources"], 50)
            return 200, "application/json", json.dumps(rows(found))
        if path == "/api/export":
            if args.get("format", "json") != "json":
                return 400, "application/json", json.dumps({"error": "only json"})
            report = rank.report(m["patterns"], m["file_groups"], m["occurrences"], m["log_sources"], m["tags"], 1000, 5, full_path=True)
            samples = F.transform("samples", lambda x: F.struct(x["text"].alias("text"), x["source"].alias("source")))
            plain = report.select(F.col("pattern_id").alias("id"), "template", F.col("occurrence_count").alias("count"), "group", "tags", samples.alias("samples"))
            return 200, "application/json", json.dumps({"patterns": rows(plain)})
        return 404, "application/json", json.dumps({"error": "not found"})

    def post(self, path: str, body: dict) -> tuple[int, str, str]:
        if path != "/api/tags":
            return 404, "application/json", json.dumps({"error": "not found"})
        changed = tags.set_tags(self.store.read("tags"), int(body["pattern_id"]), list(body["tags"]))
        self.store.replace_tags(changed)
        return 200, "application/json", json.dumps({"ok": True})


def server(store: Store, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    api = Api(store)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, result: tuple[int, str, str]) -> None:
            code, kind, text = result
            data = text.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind + "; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            url = urlparse(self.path)
            with api.lock:
                self._answer(api.get(url.path, {k: v[0] for k, v in parse_qs(url.query).items()}))

        def do_POST(self) -> None:  # noqa: N802
            text = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            with api.lock:
                self._answer(api.post(urlparse(self.path).path, json.loads(text or b"{}")))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
