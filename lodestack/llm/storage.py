"""Tables in the folder that driver and executors share.

Lineage is cut by a written Parquet table, so a lost executor costs a re-read
and never a re-computation of a non-repeatable split.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where it is unset a private folder serves a local session (tests); a cluster has none that all executors share."""
    sc = spark.sparkContext
    if configured := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
    app = sc.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        sc.setCheckpointDir(_OWN[app])
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodestack/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop_quietly, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    # at exit the JVM may be gone already; its folder then goes with the application
    try:
        if spark.sparkContext._jsc is not None:
            drop(spark, path)
    except Exception:  # noqa: BLE001
        pass


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder; return it as read from there, and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
