"""Incremental analysis: a stream of file versions keeps a table of file metrics current.

The table is cut into buckets by repository and path. A batch rewrites the buckets that its files are
in, as folders of its own, and then one pointer, which names the folder of each bucket, is switched. So
a batch costs its buckets and not the table, a reader sees the table before it or after it, and a
batch that is repeated after a crash is known by its number and left out.

Defined results: of the versions of a file the highest counts, in whatever order they come; of equal ones the
one that came last; a null content deletes the file. A deletion is remembered, so that an older version that comes late does not bring
the file back, until its version is more than `horizon` below the highest of the batches before; versions so far below are
too late and are left out. With that the table holds the files there are and recent deletions, however many versions have gone by.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack import store
from lodestack.operators.languages import source_files
from lodestack.operators.lines import line_metrics
from lodestack.shared import stored

VERSIONS = "repo_id string, path string, content string, version long"
METRICS = ("language", "blank_lines", "comment_lines", "lines_of_code")
ROWS = "repo_id string, path string, version long, language string, blank_lines long, comment_lines long, lines_of_code long"
BUCKETS = 256


def read_versions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(VERSIONS).parquet(folder)


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each file; a null content stands for a deleted file."""
    return versions.groupBy("repo_id", "path").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version"))


def measured(versions: DataFrame) -> DataFrame:
    """Metrics of each version, content left out; deleted files have nulls."""
    known = source_files(versions)
    return line_metrics(known).withColumns({c: F.when(F.col("content").isNotNull(), F.col(c)) for c in ("blank_lines", "comment_lines", "lines_of_code")}).drop("content")


def _manifest(spark: SparkSession, table: str) -> dict:
    text = store.pointed(spark, table)
    return json.loads(text) if text else {"batch": -1, "newest": None, "buckets": {}, "before": []}


def merge(batch: DataFrame, epoch: int, table: str, buckets: int = BUCKETS, horizon: int | None = None) -> None:
    """Bring the table up to date with a batch of versions; a batch that it has seen changes nothing."""
    spark = batch.sparkSession
    manifest = _manifest(spark, table)
    if manifest["batch"] >= epoch:
        return
    place = F.pmod(F.xxhash64("repo_id", "path"), F.lit(buckets)).cast("int")
    rows = stored(measured(batch.where("version is not null")).select("repo_id", "path", "version", "language", *[F.col(c).cast("long").alias(c) for c in METRICS[1:]], place.alias("bucket")), "versions")
    touched = {str(r[0]) for r in rows.select("bucket").distinct().collect()}  # no more than there are buckets
    newest = max([x for x in (manifest["newest"], rows.agg(F.max("version")).first()[0]) if x is not None], default=None)
    least = None if horizon is None or manifest["newest"] is None else manifest["newest"] - horizon
    if least is not None:
        rows = rows.where(F.col("version") >= least)
    old = [f"{table}/{folder}" for b, folder in manifest["buckets"].items() if b in touched]
    each = rows.withColumn("is_new", F.lit(1))
    if old:
        known = spark.read.schema(ROWS).parquet(*old)
        each = each.unionByName(known.withColumn("bucket", place).withColumn("is_new", F.lit(0)))
    kept = each.groupBy("repo_id", "path", "bucket").agg(F.max_by(F.struct("version", *METRICS), F.struct("version", "is_new")).alias("m")).select("repo_id", "path", "m.*", "bucket")
    if least is not None:
        kept = kept.where(F.col("lines_of_code").isNotNull() | (F.col("version") >= least))
    name = f"batch-{epoch}"
    kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/{name}")
    written = {f.removeprefix("bucket="): f"{name}/{f}" for f in store.folders_in(spark, f"{table}/{name}")}
    now = {b: folder for b, folder in manifest["buckets"].items() if b not in touched} | written
    store.switch(spark, table, json.dumps({"batch": epoch, "newest": newest, "buckets": now, "before": sorted(manifest["buckets"].values())}))
    # what the table before this batch was made of stays, as it may still be read
    needed = set(now.values()) | set(manifest["buckets"].values())
    for folder in manifest["before"]:
        if folder not in needed:
            store.clear(spark, f"{table}/{folder}")


def follow(versions: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS, horizon: int | None = None) -> StreamingQuery:
    """Keep `table` (a folder) current with a stream of versions."""
    return versions.writeStream.foreachBatch(lambda batch, epoch: merge(batch, epoch, table, buckets, horizon)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_rows(spark: SparkSession, table: str) -> DataFrame:
    """All rows of the table, those of deleted files included."""
    folders = [f"{table}/{f}" for f in _manifest(spark, table)["buckets"].values()]
    return spark.read.schema(ROWS).parquet(*folders) if folders else spark.createDataFrame([], ROWS)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest metrics of each file that still exists."""
    return stored_rows(spark, table).where("lines_of_code is not null").select("repo_id", "path", *METRICS)
