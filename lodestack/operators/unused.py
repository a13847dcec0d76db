"""Unused code: functions that nothing exported leads to, and imports that a file never names.

A package is a folder of a repository. Its functions are known by name, and a function uses
each name of the package that its text mentions, plainly or behind a dot: what may be a use
counts as one. Roots are exported names, main, init, blank names, and what is mentioned outside
of functions. What roots reach is found by semi-naive steps: a step joins the calls with
the names that the step before found alone, and drops those that are known. Each
step's names are a written table, so a step costs what it finds and no plan grows.

Defined results: sources that don't parse have no symbols and use nothing; null contents are empty and don't parse;
functions of one name in a package are used together; rows of one repository and path are files of
their own; a null repository is one of its own; an empty table gives empty tables; other columns are
not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators import goparse
from lodestack.shared import stored

SYMBOLS = (
    "package string, functions array<struct<name:string,line:int,is_exported:boolean,mentions:array<string>>>, outside array<string>, "
    "imports array<struct<path:string,alias:string,line:int,is_used:boolean>>"
)
#: Names that need no one to use them.
ROOTS = ("main", "init", "_")


def _names(tokens: list[str]) -> list[str]:
    return sorted({t for t in tokens if goparse.is_word(t)})


def _package_names(path: str) -> set[str]:
    """Names that an import's package may have."""
    parts = [p for p in path.strip('"`').split("/") if not re.fullmatch(r"v\d+", p)] or [path]
    last = re.sub(r"\.v\d+$", "", parts[-1])
    bare = last.removeprefix("go-").removesuffix("-go").removesuffix(".go")
    return {last, bare, bare.replace("-", "_"), bare.replace("-", ""), *bare.split("-"), *bare.split(".")}


def symbols(text: str) -> dict | None:
    """Package, functions with the names they mention, names mentioned outside of functions, and imports; None if the source doesn't parse."""
    parsed = goparse.parse(text)
    if parsed["error"] is not None:
        return None
    s = goparse.Source(text)
    functions, outside, before = [], [], 0
    for start, end, name in goparse.function_ranges(s):
        outside += s.tokens[before:start]
        functions.append({"name": name, "line": s.line_of(start), "is_exported": name[:1].isupper(), "mentions": [t for t in _names(s.tokens[start + 1 : end]) if t != name]})
        before = end
    outside += s.tokens[before:]
    # a name with a dot behind it and none before
    selected = {t for i, t in enumerate(s.tokens[:-1]) if s.tokens[i + 1] == "." and (i == 0 or s.tokens[i - 1] != ".")}
    imports = []
    for i in goparse.import_specs(s):
        alias = i["alias"]
        used = alias in ("_", ".") or bool(selected & ({alias} if alias else _package_names(i["path"])))
        imports.append({"path": i["path"], "alias": alias, "line": i["line"], "is_used": used or i["path"].strip('"`') == "C"})
    return {"package": s.tokens[1], "functions": functions, "outside": _names(outside), "imports": imports}


def symbol_table(files: DataFrame) -> DataFrame:
    """Go files of files(repo_id, path, content) -> (repo_id, path, folder, package, functions, outside, imports)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), goparse.ROWS):
                pdf = whole.iloc[at : at + goparse.ROWS]
                found = [symbols(t or "") for t in pdf["content"]]
                kept = [i for i, x in enumerate(found) if x is not None]
                rows = pd.DataFrame([found[i] for i in kept], columns=["package", "functions", "outside", "imports"])
                yield pd.concat([pdf[["repo_id", "path"]].iloc[kept].reset_index(drop=True), rows], axis=1)

    out = files.select("repo_id", "path", "content").mapInPandas(run, f"repo_id string, path string, {SYMBOLS}")
    return out.select("repo_id", "path", F.regexp_replace("path", "[^/]*$", "").alias("folder"), "package", "functions", "outside", "imports")


def calls(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbol_table -> nodes(repo_id, folder, name, is_root) by name, and edges(repo_id, folder, name, callee) between names of a package."""
    key = [F.coalesce("repo_id", F.lit("")).alias("repo_id"), F.col("repo_id").isNull().alias("no_repo"), "folder"]
    each = table.select(*key, "package", F.explode("functions").alias("f"))
    root = F.col("f.is_exported") | ((F.col("f.name") == "main") & (F.col("package") == "main")) | F.col("f.name").isin(*ROOTS[1:])
    nodes = each.groupBy("repo_id", "no_repo", "folder", F.col("f.name").alias("name")).agg(F.bool_or(root).alias("is_root"))
    at = ["repo_id", "no_repo", "folder"]
    outside = table.select(*key, F.explode("outside").alias("name")).distinct().withColumn("outside", F.lit(True))
    nodes = nodes.join(outside, [*at, "name"], "left").select(*at, "name", (F.col("is_root") | F.coalesce("outside", F.lit(False))).alias("is_root"))
    mentioned = each.select(*at, F.col("f.name").alias("name"), F.explode("f.mentions").alias("callee")).distinct()
    # only what is a function of the package, and isn't a root anyway
    callees = nodes.where(~F.col("is_root")).select(*at, F.col("name").alias("callee"))
    return nodes, mentioned.join(callees, [*at, "callee"])


def reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Names that roots lead to, roots included, with the step (from 0) that found them."""
    at = ["repo_id", "no_repo", "folder"]
    known = frontier = stored(nodes.where("is_root").select(*at, "name", F.lit(0).alias("step")), "reached")
    step = 0
    while True:
        step += 1
        new = edges.join(frontier.select(*at, "name"), [*at, "name"]).select(*at, F.col("callee").alias("name")).distinct().join(known.select(*at, "name"), [*at, "name"], "left_anti")
        frontier = stored(new.withColumn("step", F.lit(step)), "reached")
        if frontier.isEmpty():
            return known
        known = known.unionAll(frontier)
        if step % 16 == 0:  # many small tables become one
            known = stored(known, "reached")


def unused_functions(table: DataFrame) -> DataFrame:
    """symbol_table -> (repo_id, file_path, name, line) of functions that no root leads to."""
    table = stored(table, "symbols")
    nodes, edges = calls(table)
    nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    at = ["repo_id", "no_repo", "folder", "name"]
    dead = nodes.join(reachable(nodes, edges), at, "left_anti").select(*at)
    rows = table.select(F.coalesce("repo_id", F.lit("")).alias("repo_id"), F.col("repo_id").isNull().alias("no_repo"), "folder", F.col("path").alias("file_path"), F.explode("functions").alias("f"))
    rows = rows.select("repo_id", "no_repo", "folder", "file_path", F.col("f.name").alias("name"), F.col("f.line").alias("line"))
    return rows.join(dead, at, "left_semi").select(F.when(~F.col("no_repo"), F.col("repo_id")).alias("repo_id"), "file_path", "name", "line")


def unused_imports(table: DataFrame) -> DataFrame:
    """symbol_table -> (repo_id, file_path, import_path, alias, line) of imports that their file never names."""
    each = table.select("repo_id", F.col("path").alias("file_path"), F.explode("imports").alias("i")).where("not i.is_used")
    return each.select("repo_id", "file_path", F.col("i.path").alias("import_path"), F.coalesce("i.alias", F.lit("")).alias("alias"), "i.line")


def unused_issues(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """Both as issues."""
    issue = lambda message, suggestion: [F.lit("unused_code").alias("type"), F.lit("warning").alias("severity"), "line", message.alias("message"), F.lit(suggestion).alias("suggestion")]
    a = functions.select("repo_id", "file_path", *issue(F.concat(F.lit("Function '"), F.col("name"), F.lit("' is never used")), "Consider removing it"))
    return a.unionByName(imports.select("repo_id", "file_path", *issue(F.concat(F.lit("Import "), F.col("import_path"), F.lit(" is never used")), "Consider removing it")))
