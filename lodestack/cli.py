"""python -m lodestack.cli: context build|show|clear, review latest|diff|file, doctor, version."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import config as settings
from lodestack import report, store
from lodestack.operators import clones, embed, goparse, hunks, languages, review, rules, similarity, unused
from lodestack.plans.analysis import analyse
from lodestack.sources import files as file_source
from lodestack.sources import git

VERSION = "0.1.0"


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("lodestack").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    git.register(spark)
    return spark


def _provider(config: settings.Config) -> embed.Provider:
    """The provider that the settings name, with their model; where it doesn't answer the other one with its own, and hashes where none does."""
    wanted, key = config.embeddings, config.embeddings.api_key or config.llm.api_key
    if wanted.provider == "hashing":
        return embed.HashingProvider()
    here = wanted.provider == "local"
    model = {"model": wanted.model} if wanted.model else {}
    local = embed.LocalHttpProvider(**(model if here else {}), **({"base_url": config.llm.base_url} if config.llm.provider == "local" and config.llm.base_url else {}))
    cloud = [embed.CloudHttpProvider(key, **({} if here else model))] if key else []
    return embed.first_working([*([local, *cloud] if here else [*cloud, local]), embed.HashingProvider()])


def _files(spark: SparkSession, root: str) -> DataFrame:
    return file_source.read_listed(spark, root, os.path.basename(root))


def _folder(root: str) -> str:
    return f"{root}/.lodestack/context"


def build(spark: SparkSession, root: str, config: settings.Config, force: bool = False, incremental: bool = False) -> dict[str, DataFrame]:
    """Analyse and store. incremental: vectors of unchanged functions are kept. Without force, an existing context is left alone unless incremental."""
    folder = _folder(root)
    if store.exists(spark, folder) and not (force or incremental):
        return {n: store.load(spark, folder, n) for n in store.TABLES}
    provider = _provider(config)
    files = _files(spark, root)
    tables = analyse(files, config)
    go = languages.source_files(files).where("language = 'Go'")
    symbols = unused.symbol_table(go)
    tables["duplications"] = clones.duplication_issues(clones.clone_pairs(go))
    tables["unused"] = unused.unused_issues(unused.unused_functions(symbols), unused.unused_imports(symbols))
    described = embed.describe(tables["functions"])
    if incremental and store.exists(spark, folder):
        tables["embeddings"] = embed.refreshed(described, store.load(spark, folder, "embeddings"), provider)
    else:
        tables["embeddings"] = embed.embed(described, provider)
    store.save(tables, folder)
    return {n: store.load(spark, folder, n) for n in store.TABLES}


def _duplicates(spark: SparkSession, root: str, config: settings.Config, functions: DataFrame) -> DataFrame | None:
    """Functions of the stored context that some functions are near to, by the settings' threshold; None without a context."""
    if not store.exists(spark, _folder(root)):
        return None
    asked = embed.embed(embed.describe(functions), _provider(config))
    return similarity.duplicates_of(store.load(spark, _folder(root), "embeddings"), asked, config.analysis.similarity_threshold)


def review_commit(spark: SparkSession, root: str, config: settings.Config, revision: str = "HEAD") -> dict:
    """Issues of the functions that the commit touches, as they are in it, and what they duplicate."""
    read = spark.read.format("git").option("path", root).option("range", revision).option("latest", "true")
    content = read.option("table", "content").load().select(F.lit("").alias("repo_id"), "path", "content")
    parsed = goparse.parse_go(languages.source_files(content).where("language = 'Go'"))
    diff = read.option("table", "diff_files").load()
    functions = hunks.touched_functions(goparse.functions_of(parsed), diff).drop("commit").distinct()
    found = rules.issues(functions, config.analysis.complexity_threshold, config.analysis.max_function_length)
    return report.changes(read.option("table", "commits").load(), diff, found, _duplicates(spark, root, config, functions))


def review_range(spark: SparkSession, root: str, selection: str, config: settings.Config) -> dict:
    """Changes of a range, and issues in the changed files as they are in the working tree."""
    diff = spark.read.format("git").option("path", root).option("table", "range_diff").option("range", selection).load()
    changed = review.changed_files(languages.source_files(_files(spark, root)), diff)
    functions = goparse.functions_of(goparse.parse_go(changed.where("language = 'Go'")))
    found = rules.issues(functions, config.analysis.complexity_threshold, config.analysis.max_function_length)
    none = spark.createDataFrame([], "short_hash string, author string, email string, date timestamp, message string")
    return report.changes(none, diff, found, _duplicates(spark, root, config, functions))


def review_file(spark: SparkSession, root: str, path: str, config: settings.Config) -> dict:
    one = _files(spark, root).where(F.col("path") == path)
    functions = goparse.functions_of(goparse.parse_go(one))
    found = rules.issues(functions, config.analysis.complexity_threshold, config.analysis.max_function_length).unionByName(rules.naming_issues(functions))
    none = spark.createDataFrame([], "short_hash string, author string, email string, date timestamp, message string")
    diff = spark.createDataFrame([], "status string, path string, additions int, deletions int")
    return report.changes(none, diff, found, _duplicates(spark, root, config, functions))


def doctor(root: str, config_path: str) -> list[tuple[str, str]]:
    installed = git.is_git_installed()
    try:
        place = f"found (branch: {git.current_branch(git.find_root(root))})" if installed else "git is missing"
    except Exception:  # noqa: BLE001
        place = "not in a repository"
    path = config_path or settings.DEFAULT_PATH
    config = settings.load(path)
    try:
        config.validate()
        valid = "valid"
    except ValueError as e:
        valid = f"not valid: {e}"
    return [
        ("Git", git.git_version() if installed else "not found"), ("Repository", place), ("Configuration", "found" if os.path.exists(path) else "not found (optional)"),
        ("API key", f"configured ({config.llm.provider})" if config.llm.api_key else "not configured"), ("Embedding model", config.embeddings.model or "not configured"), ("Settings", valid),
    ]


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestack")
    parser.add_argument("-v", "--verbose", action="store_true")
    parser.add_argument("-c", "--config", default="")
    parser.add_argument("--root", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    context = commands.add_parser("context").add_subparsers(dest="action", required=True)
    b = context.add_parser("build")
    b.add_argument("-f", "--force", action="store_true")
    b.add_argument("-i", "--incremental", action="store_true")
    context.add_parser("show")
    context.add_parser("clear")
    r = commands.add_parser("review")
    r.add_argument("--ci", action="store_true", help="exit with 1 if there are issues")
    r.add_argument("-o", "--output", default="text", choices=["text", "json", "markdown", "html"])
    r.add_argument("--output-file", default="")
    actions = r.add_subparsers(dest="action", required=True)
    actions.add_parser("latest")
    actions.add_parser("diff").add_argument("range")
    actions.add_parser("file").add_argument("file")
    commands.add_parser("doctor")
    commands.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(f"lodestack {VERSION}")
        return 0
    if args.command == "doctor":
        print("\n".join(f"{name + ':':<20} {state}" for name, state in doctor(args.root, args.config)))
        return 0
    root, config = git.find_root(args.root), settings.load(args.config)
    spark = _spark()
    if args.verbose:
        print(f"Repository: {root}", file=sys.stderr)
    if args.command == "context":
        if args.action == "clear":
            print("cleared" if store.clear(spark, _folder(root)) else "nothing to clear")
            return 0
        if args.action == "show" and not store.exists(spark, _folder(root)):
            print("no context; run `context build` first")
            return 1
        tables = build(spark, root, config, args.force, args.incremental) if args.action == "build" else {n: store.load(spark, _folder(root), n) for n in store.TABLES}
        print(report.render(report.summary(tables)))
        return 0
    data = review_commit(spark, root, config) if args.action == "latest" else review_range(spark, root, args.range, config) if args.action == "diff" else review_file(spark, root, args.file, config)
    text = report.render(data, args.output)
    if args.output_file:
        with open(args.output_file, "w") as f:
            f.write(text)
    else:
        print(text)
    return int(args.ci and bool(data["issues"]))


if __name__ == "__main__":
    sys.exit(main())
