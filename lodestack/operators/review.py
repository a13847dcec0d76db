"""Changes of commits: tables of files, joins with what was analysed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalar import numstat_fields


def changes(numstat: DataFrame, statuses: DataFrame | None = None, patches: DataFrame | None = None) -> DataFrame:
    """numstat(commit, line) with statuses(commit, path, status; M where missing) and patches(commit, path, patch; '' where missing)."""
    fields = numstat_fields(F.col("parts"))
    rows = numstat.select("commit", F.split("line", "\t", 3).alias("parts")).select("commit", fields.alias("f")).where("f is not null").select("commit", "f.path", "f.additions", "f.deletions")
    if statuses is None:
        out = rows.withColumn("status", F.lit("M"))
    else:
        out = rows.join(statuses.select("commit", "path", "status"), ["commit", "path"], "left").withColumn("status", F.coalesce("status", F.lit("M")))
    if patches is None:
        return out.withColumn("patch", F.lit(""))
    return out.join(patches.select("commit", "path", "patch"), ["commit", "path"], "left").withColumn("patch", F.coalesce("patch", F.lit("")))


def diff_summary(diff_files: DataFrame) -> DataFrame:
    """(commit, n_files, additions, deletions)"""
    return diff_files.groupBy("commit").agg(F.count("*").alias("n_files"), F.sum("additions").cast("long").alias("additions"), F.sum("deletions").cast("long").alias("deletions"))


def full_diff(diff_files: DataFrame) -> DataFrame:
    """(commit, patch): patches of a commit's files in order of path."""
    return diff_files.groupBy("commit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "patch"))), lambda x: x["patch"]), "").alias("patch"))


def latest_commit(commits: DataFrame) -> DataFrame:
    return commits.orderBy(F.desc("date"), "hash").limit(1)


def changed_files(files: DataFrame, diff_files: DataFrame) -> DataFrame:
    """Source files that a change names; paths that are no longer there drop out."""
    return files.join(diff_files.select("path").distinct(), "path", "left_semi")
