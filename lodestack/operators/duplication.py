"""Duplicate blocks by hash. (The reference only outlines this; results here are our own definition.)"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalar import lines, trimmed

LEAST_LINES = 6


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(hash, n, first_id) of texts that occur more than once. Counts are combined before the shuffle."""
    return docs.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("hash")).agg(F.count("*").alias("n"), F.min(id_column).alias("first_id")).where("n > 1")


def duplicate_blocks(files: DataFrame, n_lines: int = LEAST_LINES) -> DataFrame:
    """(hash, n_places, n_files, first_path, first_line): runs of n_lines trimmed, non-blank lines that occur more than once.

    One row per hash with its least place; places are not paired."""
    numbered = F.filter(F.transform(lines(F.col("content")), lambda x, i: F.struct(trimmed(x).alias("t"), (i + 1).alias("i"))), lambda x: x["t"] != "")
    starts = F.sequence(F.lit(1), F.size("l") - n_lines + 1)
    block = lambda k: F.struct(F.sha2(F.array_join(F.transform(F.slice("l", k, n_lines), lambda x: x["t"]), "\n"), 256).alias("hash"), F.element_at("l", k)["i"].alias("line"))
    each = files.select("path", numbered.alias("l")).where(F.size("l") >= n_lines).select("path", F.explode(F.transform(starts, block)).alias("b"))
    by_file = each.groupBy("b.hash", "path").agg(F.count("*").alias("n"), F.min("b.line").alias("line"))
    return by_file.groupBy("hash").agg(F.sum("n").alias("n_places"), F.count("path").alias("n_files"), F.min(F.struct("path", "line")).alias("first")).where("n_places > 1").select("hash", "n_places", "n_files", F.col("first.path").alias("first_path"), F.col("first.line").alias("first_line"))
