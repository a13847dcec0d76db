"""Source trees as files(repo_id, path, content)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.registry import IGNORED_DIRECTORIES
from lodestack.functions.scalar import is_pruned


def read_tree(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """All files below a folder, by Spark's binary reader; paths relative to it. Content is decoded lazily, so a query of paths reads none."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^[a-z][a-z0-9+.-]*:/*", "/")
    prefix = "/" + base.split(":", 1)[-1].lstrip("/") + "/"
    relative = F.substring(plain, len(prefix) + 1, 1 << 20)
    files = raw.select(F.lit(repo_id).alias("repo_id"), relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return files.where(~is_pruned(F.col("path")))


def read_listed(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """The same for a local tree with large ignored folders: they are pruned while walking, so Spark never lists them."""
    found = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if not n.startswith(".") and n not in IGNORED_DIRECTORIES)
        found += [os.path.relpath(os.path.join(folder, f), root) for f in sorted(files)]
    prefix = os.path.abspath(root)
    raw = spark.read.format("binaryFile").load([os.path.join(prefix, f) for f in found]) if found else spark.createDataFrame([], "path string, content binary")
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^[a-z]+:/*", "/")
    return raw.select(F.lit(repo_id).alias("repo_id"), F.substring(plain, len(prefix) + 2, 1 << 20).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
