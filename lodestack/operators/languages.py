"""Files by language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.registry import UNKNOWN
from lodestack.functions.scalar import is_pruned, language_of


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def source_files(files: DataFrame) -> DataFrame:
    """Files of a known language outside ignored directories."""
    return with_language(files.where(~is_pruned(F.col("path")))).where(F.col("language") != UNKNOWN)


def language_counts(files: DataFrame) -> DataFrame:
    """(repo_id, language, n_files)"""
    return source_files(files.select("repo_id", "path")).groupBy("repo_id", "language").agg(F.count("*").alias("n_files"))


def primary_language(counts: DataFrame) -> DataFrame:
    """(repo_id, language) with most files; ties go to the first in alphabetical order. One aggregation, no sort."""
    return counts.groupBy("repo_id").agg(F.min_by("language", F.struct(-F.col("n_files"), "language")).alias("language"))
