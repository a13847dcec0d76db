"""Tables of one analysis, as Parquet, and their export as single JSON documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.schemas import EMBEDDINGS

TABLES = ["languages", "frameworks", "patterns", "important_files", "file_metrics", "functions", "structs", "imports", "issues", "totals", "duplications", "unused", "embeddings"]


#: Names the version that counts.
POINTER = "CURRENT"


def _place(spark: SparkSession, path: str):
    """(path, its file system) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def pointed(spark: SparkSession, folder: str) -> str | None:
    """What the folder's pointer holds; None without one."""
    p, files = _place(spark, f"{folder}/{POINTER}")
    if not files.exists(p):
        return None
    return spark.read.text(p.toString(), wholetext=True).first()[0]


def switch(spark: SparkSession, folder: str, text: str) -> None:
    """Let the folder's pointer hold this, in one step: a reader sees what was there before, or this."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    (new, files), (pointer, _) = _place(spark, f"{folder}/{POINTER}-{uuid.uuid4().hex}"), _place(spark, f"{folder}/{POINTER}")
    out = files.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf).rename(files.makeQualified(new), files.makeQualified(pointer), how)


def folders_in(spark: SparkSession, folder: str) -> list[str]:
    p, files = _place(spark, folder)
    return [e.getPath().getName() for e in files.listStatus(p) if e.isDirectory()] if files.exists(p) else []


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """All tables are written as a new version, and then one file is switched to it: a reader sees the old version or the new one, whole, and a crash leaves one
    of them. The version before stays, as what is read from it may still be in use; older ones go."""
    spark = next(iter(tables.values())).sparkSession
    before, version = pointed(spark, folder), f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    if set(TABLES) <= set(tables):  # a whole context: as documents, too, from what is written
        whole = {name: spark.read.parquet(f"{folder}/{version}/{name}") for name in tables}
        write_context_documents(whole, f"{folder}/{version}/context.json")
        write_index_documents(whole["embeddings"], f"{folder}/{version}/index.json")
    switch(spark, folder, version)
    for name in folders_in(spark, folder):
        if name not in (version, before):
            clear(spark, f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{pointed(spark, folder)}/{name}")


def exists(spark: SparkSession, folder: str) -> bool:
    return pointed(spark, folder) is not None


def clear(spark: SparkSession, folder: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def context_document(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per repository with `value`, a JSON document {detection, analysis}. Functions stay in their table."""
    listed = lambda name, *columns, key=None: tables[name].groupBy("repo_id").agg((F.map_from_entries if key else lambda x: x)(F.array_sort(F.collect_list(F.struct(*columns)))).alias(name))
    out = tables["totals"].select("repo_id", F.struct(*[c for c in tables["totals"].columns if c != "repo_id"]).alias("totals"))
    for part in (
        listed("languages", "language", "n_files", key=True), listed("frameworks", "ordinal", "name", "type", "language"), listed("patterns", "ordinal", "pattern"),
        tables["important_files"].groupBy("repo_id").agg(F.array_sort(F.collect_list("path")).alias("files")),
        tables["issues"].groupBy("repo_id").agg(F.count("*").alias("total_issues")),
    ):
        out = out.join(part, "repo_id", "left")
    document = F.struct(F.struct("languages", "frameworks", "patterns", "files").alias("detection"), F.struct("totals", F.coalesce("total_issues", F.lit(0)).alias("total_issues")).alias("analysis"))
    return out.select("repo_id", F.to_json(document).alias("value"))


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in one file; for small results."""
    df.coalesce(1).write.mode("overwrite").json(path)


#: Of the index format.
INDEX_VERSION = "1.0"


def write_context_documents(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON document a repository, in folders by repository."""
    context_document(tables).write.partitionBy("repo_id").mode("overwrite").text(path)


def write_index_documents(embeddings: DataFrame, path: str) -> None:
    """One JSON document {version, provider, dimension, embeddings: [...]} a repository and provider, in folders by both.

    A document is as long as its repository has functions, so it is written line by line, in order of id: no row or group holds it whole. Head and end
    stand with the first and the last vector, so that one window decides where all of a document goes."""
    keys = ["repo_id", "by", "dimension"]
    good = embeddings.where("embedding is not null").withColumnsRenamed({"provider": "by", "dim": "dimension"})
    element = F.struct("id", "file_path", F.col("func_name").alias("function_name"), "start_line", "end_line", "code", "embedding", "language")
    order = Window.partitionBy(*keys).orderBy("id", "file_path", "start_line")
    rows = good.select(*keys, "id", "file_path", "start_line", F.to_json(element, {"ignoreNullFields": "false"}).alias("element"))
    placed = rows.withColumns({"is_first": F.row_number().over(order) == 1, "is_last": F.lead(F.lit(True), 1, False).over(order) == F.lit(False)})
    name = F.to_json(F.array("by"))  # quoted as JSON wants it
    head = F.concat(F.lit(f'{{"version": "{INDEX_VERSION}", "provider": '), F.substring(name, F.lit(2), F.length(name) - 2), F.lit(', "dimension": '), F.col("dimension").cast("string"), F.lit(', "embeddings": [\n'))
    line = F.concat(F.when(F.col("is_first"), head).otherwise(","), "element", F.when(F.col("is_last"), "\n]}").otherwise(""))
    placed.select(*keys, line.alias("line")).write.partitionBy(*keys).mode("overwrite").text(path)


def read_index_document(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an exported index, one document {embeddings: [...], dimension, provider, version}."""
    element = "id string, file_path string, function_name string, start_line int, end_line int, code string, embedding array<float>, language string"
    nested = ",".join(":".join(x.strip().split(" ", 1)) for x in element.split(","))
    doc = spark.read.schema(f"embeddings array<struct<{nested}>>, dimension int, provider string, version string").option("multiLine", True).json(path)
    return doc.select(F.explode("embeddings").alias("e"), "provider").select("e.*", "provider", F.size("e.embedding").alias("dim"))


def empty_embeddings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EMBEDDINGS)
