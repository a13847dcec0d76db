"""Intermediate tables in the folder that driver and executors share.

A written table ends the lineage of what is read from it, so that steps which follow each
other many times neither repeat nor grow, and a lost executor costs a re-read.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` as the session has it; a local session without one gets a folder of its own, a cluster an error."""
    context = spark.sparkContext
    setting = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if setting:
        return setting.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="lodestack-"))


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM can be gone by then
        pass


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, written and read again; rows of one value of the last columns `by` are in files of their own."""
    spark = df.sparkSession
    path = f"{folder(spark)}/lodestack/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove_at_exit, spark, path)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
