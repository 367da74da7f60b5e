"""Results written out: CSV and JSON exports, snapshots, the report page."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.tokens import csv_cell
from strataloom.operators.rank import ranked, samples


def export_rows(
    patterns: DataFrame,
    groups: DataFrame,
    occurrences: DataFrame,
    sources: DataFrame,
    suppressed: DataFrame | None = None,
    top: int = 500,
    n_samples: int = 5,
    filters: list[str] | None = None,
    in_groups: list[str] | None = None,
) -> DataFrame:
    """``id, group, template, occurrence_count, sample_1..n``. Suppressed patterns drop out after the top ones are
    chosen; missing samples are empty."""
    best = ranked(patterns, groups, top, filters, in_groups)
    if suppressed is not None:
        best = best.join(suppressed.select(F.col("pattern_id").alias("_x")), F.col("pattern_id") == F.col("_x"), "left_anti")
    keys = best.select(F.col("pattern_id").alias("_k"))
    wanted = occurrences.join(keys, F.col("pattern_id") == F.col("_k"), "left_semi")
    shown = samples(wanted, patterns, sources, n_samples).groupBy(F.col("pattern_id").alias("sp")).agg(
        *(F.max(F.when(F.col("rank") == i, F.col("text"))).alias(f"sample_{i}") for i in range(1, n_samples + 1))
    )
    return best.join(shown, F.col("pattern_id") == F.col("sp"), "left").select(
        F.col("pattern_id").alias("id"), "group", "template", "occurrence_count",
        *(F.coalesce(f"sample_{i}", F.lit("")).alias(f"sample_{i}") for i in range(1, n_samples + 1)),
    )


def export_nested(
    patterns: DataFrame, groups: DataFrame, occurrences: DataFrame, sources: DataFrame, suppressed: DataFrame | None = None,
    top: int | None = 500, n_samples: int = 5, filters: list[str] | None = None, in_groups: list[str] | None = None,
) -> DataFrame:
    """As ``export_rows`` with ``samples`` as an array of ``text, source``; patterns without samples have an empty one."""
    best = ranked(patterns, groups, top, filters, in_groups)
    if suppressed is not None:
        best = best.join(suppressed.select(F.col("pattern_id").alias("_x")), F.col("pattern_id") == F.col("_x"), "left_anti")
    wanted = occurrences.join(best.select(F.col("pattern_id").alias("_k")), F.col("pattern_id") == F.col("_k"), "left_semi")
    shown = samples(wanted, patterns, sources, n_samples).groupBy(F.col("pattern_id").alias("sp")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "text", "source"))).alias("s")  # n_samples at most
    )
    plain = F.transform(F.coalesce("s", F.array().cast("array<struct<rank:int,text:string,source:string>>")), lambda x: F.struct(x["text"].alias("text"), x["source"].alias("source")))
    return best.join(shown, F.col("pattern_id") == F.col("sp"), "left").select(
        F.col("pattern_id").alias("id"), "group", "template", "occurrence_count", plain.alias("samples")
    ).orderBy(F.desc("occurrence_count"), "id")


def write_array(rows: DataFrame, path: str) -> None:
    """The rows as one JSON array in a file on the driver, which holds a partition of them at a time."""
    with open(path, "x", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(rows.select(F.to_json(F.struct(*rows.columns))).toLocalIterator()):
            f.write(("," if i else "") + "\n" + r[0])
        f.write("\n]\n")


def csv_lines(rows: DataFrame) -> DataFrame:
    """``line``: the rows as CSV, quoted only where needed. The header is the column names."""
    return rows.select(F.concat_ws(",", *(csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns)).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").json(path)


def save_baseline(snapshot: DataFrame, path: str) -> None:
    """Keeps what was counted; fails if there is a baseline at ``path``."""
    snapshot.where("occurrence_count > 0").write.mode("errorifexists").parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}td,th{{text-align:left;padding:.3em .8em;border-bottom:1px solid #ddd}}pre{{margin:0;white-space:pre-wrap}}</style>
</head><body><h1>{title}</h1><table id="t"><tr><th>Count</th><th>Group</th><th>Template</th><th>Samples</th></tr></table>
<script>const DATA = {data};
const table = document.getElementById("t");
for (const p of DATA.patterns.filter(p => !p.suppressed)) {{
  const row = table.insertRow();
  for (const text of [p.occurrence_count, p.group, p.template, (p.samples || []).map(s => s.text).join("\\n")]) {{
    const cell = document.createElement("pre"); cell.textContent = text; row.insertCell().appendChild(cell);
  }}
}}</script></body></html>"""


def render_page(report: DataFrame, title: str, has_timestamps: bool = True) -> str:
    """One page with the report's rows, which ``rank.report`` has bounded by its ``top``."""
    rows = [json.loads(r[0]) for r in report.select(F.to_json(F.struct(*report.columns))).collect()]
    data = json.dumps({"has_timestamps": has_timestamps, "patterns": rows}).replace("</", "<\\/")
    return PAGE.format(title=title.replace("<", "&lt;"), data=data)
