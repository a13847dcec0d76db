"""Aggregates over files, functions and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 10


def file_function_stats(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Per file: functions, longest, average length, complexity; zeros for files without functions."""
    stats = functions.groupBy("repo_id", "file_path").agg(F.count("*").alias("n"), F.max("loc").cast("long").alias("longest"), F.avg("loc").alias("average"), F.sum("complexity").cast("long").alias("total"))
    f = files.select("repo_id", F.col("path").alias("file_path"))
    zero = lambda c, kind, name: F.coalesce(c, F.lit(0)).cast(kind).alias(name)
    return f.join(stats, ["repo_id", "file_path"], "left").select("repo_id", "file_path", zero("n", "long", "function_count"), zero("longest", "long", "max_function_length"), zero("average", "double", "avg_function_length"), zero("total", "long", "cyclomatic_complexity"))


def repo_totals(file_metrics: DataFrame) -> DataFrame:
    """Sums over files; the average is over functions, so it is weighted by their number in each file."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = ["lines_of_code", "comment_lines", "blank_lines", "cyclomatic_complexity", "function_count", "class_count"]
    length = F.sum(F.col("avg_function_length") * F.col("function_count"))
    n = F.sum("function_count")
    return file_metrics.groupBy("repo_id").agg(F.count("*").alias("file_count"), *map(total, sums), F.coalesce(F.max("max_function_length"), F.lit(0)).alias("max_function_length"), F.when(n > 0, length / n).otherwise(0.0).alias("avg_function_length"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """(repo_id, by, value, n): totals, by type and by severity from one pass."""
    sets = issues.groupingSets([["repo_id", "type"], ["repo_id", "severity"], ["repo_id"]], "repo_id", "type", "severity").agg(F.grouping("type").alias("gt"), F.grouping("severity").alias("gs"), F.count("*").alias("n"))
    by = F.when(F.col("gt") == 0, "type").when(F.col("gs") == 0, "severity").otherwise("total")
    return sets.select("repo_id", by.alias("by"), F.coalesce("type", "severity", F.lit("")).alias("value"), "n")


def top_by(functions: DataFrame, measure: str, n: int = TOP) -> DataFrame:
    """The n largest, in a total order: measure descending, then place and all other columns."""
    rest = [c for c in ("repo_id", "file_path", "start_line", "name", "loc", "complexity") if c != measure and c in functions.columns]
    return functions.orderBy(F.desc(measure), *rest).limit(n)


def top_by_complexity(functions: DataFrame, n: int = TOP) -> DataFrame:
    return top_by(functions, "complexity", n)


def top_by_length(functions: DataFrame, n: int = TOP) -> DataFrame:
    return top_by(functions, "loc", n)
