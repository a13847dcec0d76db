"""Rules over functions: issues, style, and the additive score of boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalar import has_invalid_name, is_generic_name

MAX_COMPLEXITY = 10
MAX_LENGTH = 50


# What an issue has besides its file.
_COLUMNS = ("type", "severity", "line", "message", "suggestion")


def _columns(kind: str, severity: str, message: Column, suggestion: str | None) -> list[Column]:
    values = (F.lit(kind), F.lit(severity), F.col("start_line"), message, F.lit(suggestion).cast("string"))
    return [value.alias(name) for name, value in zip(_COLUMNS, values, strict=True)]


def _issue(functions: DataFrame, kind: str, severity: str, message: Column, suggestion: str | None) -> DataFrame:
    return functions.select("repo_id", "file_path", *_columns(kind, severity, message, suggestion))


def complexity_issue(most: int) -> tuple[Column, Column]:
    """Whether a function has the issue, and the issue."""
    message = F.format_string("Function '%s' has high complexity: %d", "name", "complexity")
    return F.col("complexity") > most, F.struct(*_columns("complexity", "warning", message, "Consider breaking down this function into smaller functions"))


def length_issue(most: int) -> tuple[Column, Column]:
    """Whether a function has the issue, and the issue."""
    message = F.format_string("Function '%s' is too long: %d lines", "name", "loc")
    return F.col("loc") > most, F.struct(*_columns("function_length", "warning", message, "Consider refactoring into smaller functions"))


def complexity_issues(functions: DataFrame, most: int = MAX_COMPLEXITY) -> DataFrame:
    test, issue = complexity_issue(most)
    return functions.where(test).select("repo_id", "file_path", issue.alias("issue")).select("repo_id", "file_path", *[f"issue.{c}" for c in _COLUMNS])


def length_issues(functions: DataFrame, most: int = MAX_LENGTH) -> DataFrame:
    test, issue = length_issue(most)
    return functions.where(test).select("repo_id", "file_path", issue.alias("issue")).select("repo_id", "file_path", *[f"issue.{c}" for c in _COLUMNS])


def issues(functions: DataFrame, most_complexity: int = MAX_COMPLEXITY, most_length: int = MAX_LENGTH) -> DataFrame:
    """Complexity and length issues; what `functions` costs is paid once."""
    kinds = [complexity_issue(most_complexity), length_issue(most_length)]
    found = F.array_compact(F.array(*[F.when(test, issue) for test, issue in kinds]))
    return functions.select("repo_id", "file_path", F.explode(found).alias("issue")).select("repo_id", "file_path", *[f"issue.{c}" for c in _COLUMNS])


def naming_issues(functions: DataFrame) -> DataFrame:
    message = F.format_string("Function '%s' may not follow naming conventions", "name")
    return _issue(functions.where(has_invalid_name(F.col("name"))), "naming", "info", message, None)


def ai_patterns(functions: DataFrame) -> DataFrame:
    """Functions whose score is above 0.5, with what they scored for. Sums are of doubles, in this order."""
    tests = [
        (is_generic_name(F.col("name")), 0.2, "Generic function name"),
        (F.col("loc") > 100, 0.3, "Excessively long function"),
        (F.col("complexity") > 20, 0.3, "Very high complexity"),
        (F.size("parameters") > 5, 0.2, "Too many parameters"),
    ]
    confidence = F.lit(0.0)
    for test, points, _ in tests:
        confidence = confidence + F.when(test, F.lit(points)).otherwise(F.lit(0.0))
    found = F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, _, label in tests]))
    scored = functions.withColumns({"confidence": confidence, "indicators": found}).where(F.col("confidence") > F.lit(0.5))
    return scored.select("repo_id", "file_path", "name", "start_line", "end_line", F.lit("Potentially AI-generated boilerplate").alias("pattern"), "confidence", "indicators")
