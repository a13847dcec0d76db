"""Reports from the small aggregates of an analysis, as text, JSON, Markdown or HTML."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.registry import TYPE_ORDER
from lodestack.functions.scalar import severity_icon, shown_status
from lodestack.operators import frameworks, metrics

SHOWN = 5


def summary(tables: dict[str, DataFrame]) -> dict:
    """What a report shows, as plain data; every part is an aggregate or a top list."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    types = frameworks.by_type(tables["frameworks"]).orderBy("repo_id", "rank")
    return {
        "languages": rows(tables["languages"].orderBy(F.desc("n_files"), "language")), "frameworks": [r for r in rows(types) if r["type"] in TYPE_ORDER],
        "patterns": [r["pattern"] for r in tables["patterns"].orderBy("repo_id", "ordinal").collect()], "files": [r["path"] for r in tables["important_files"].orderBy("path").collect()],
        "totals": rows(tables["totals"]), "issues": rows(metrics.issue_summary(tables["issues"]).orderBy("repo_id", "by", "value")),
        "duplications": rows(tables["duplications"].groupBy("repo_id").agg(F.count("*").alias("n"))), "unused": rows(tables["unused"].groupBy("repo_id").agg(F.count("*").alias("n"))),
        "most_complex": rows(metrics.top_by_complexity(tables["functions"], SHOWN).select("file_path", "name", "complexity", "loc")),
    }


def changes(commit: DataFrame, diff_files: DataFrame, issues: DataFrame, duplicates: DataFrame | None = None) -> dict:
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    when = F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date")
    return {
        "commit": rows(commit.select("short_hash", "author", "email", when, "message")),
        "changes": rows(diff_files.select(shown_status(F.col("status")).alias("status"), "path", "additions", "deletions").orderBy("path")),
        "issues": rows(issues.select("file_path", "line", severity_icon(F.col("severity")).alias("icon"), "severity", "message", "suggestion").orderBy("file_path", "line", "message")),
        **({} if duplicates is None else {"duplicates": rows(duplicates.select(*[c for c in duplicates.columns if c != "similarity"], F.round(F.col("similarity").cast("double"), 3).alias("similarity")).orderBy("file_path", "start_line", F.desc("similarity"), "other_path", "other_line"))}),
    }


def _sections(data: dict) -> list[tuple[str, list[str]]]:
    out = []
    for name, value in data.items():
        entries = []
        for row in value:
            if isinstance(row, dict):
                parts = [f"{k}: {', '.join(x['name'] for x in v) if isinstance(v, list) else f'{v:.1f}' if isinstance(v, float) else v}" for k, v in row.items() if v is not None]
                entries.append("; ".join(parts))
            else:
                entries.append(str(row))
        out.append((name.replace("_", " ").capitalize(), entries or ["none"]))
    return out


def render(data: dict, form: str = "text") -> str:
    if form == "json":
        return json.dumps(data, indent=2, ensure_ascii=False, default=str)
    sections = _sections(data)
    if form == "markdown":
        return "\n".join(f"## {title}\n\n" + "".join(f"- {x}\n" for x in entries) for title, entries in sections)
    if form == "html":
        return "<!doctype html><meta charset=utf-8>" + "".join(f"<h2>{html.escape(t)}</h2><ul>" + "".join(f"<li>{html.escape(x)}" for x in entries) + "</ul>" for t, entries in sections)
    if form == "text":
        return "\n".join(f"{title}:\n" + "".join(f"  - {x}\n" for x in entries) for title, entries in sections)
    raise ValueError(f"unknown form {form!r}")
