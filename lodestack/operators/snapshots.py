"""Changes between two snapshots of files, and snapshots rebuilt from changes: no git process, any source of files.

A snapshot is a table (commit, path, content): the files before and after each change that `commit` names. Each is read once and stored
with hashes. Paths and hashes meet first, and texts are shuffled of the files that differ only, once a side (and again those that come or go where renames are looked for). Deleted and added files
are renames where `renames` finds them. Each pair of texts is one row of an Arrow batch,
so a file's size bounds what a task holds, and patches leave in batches of BATCH_BYTES.

Defined results: null contents count as empty; rows without commit or path are left out; rows that repeat commit and path
count once, with the greatest hash of their content; files alike on both sides give no row; binary files (with a NUL) have a
patch that says so and no lines; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators import linediff, renames
from lodestack.schemas import DIFF_FILES
from lodestack.shared import stored

#: Characters of output in one Arrow batch, and its rows at most.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 1 << 14


def _hashed(rows: DataFrame) -> DataFrame:
    files = rows.where("commit is not null and path is not null").select("commit", "path", F.coalesce("content", F.lit("")).alias("content"))
    return files.withColumn("hash", F.sha2("content", 256))


def _texts(files: DataFrame, wanted: DataFrame, hash_column: str) -> DataFrame:
    """Contents of the wanted (commit, path), one row each, partitioned by them: the hashes are no key of the join."""
    keys = wanted.select("commit", "path", F.col(hash_column).alias("wanted"))
    content = F.first(F.when(F.col("hash") == F.col("wanted"), F.col("content")), ignorenulls=True)
    return files.join(keys, ["commit", "path"]).groupBy("commit", "path").agg(content.alias("content"))


def _flushed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_BYTES of their last column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if size >= BATCH_BYTES or len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def diff(old: DataFrame, new: DataFrame, least: float | None = renames.LEAST, context: int = linediff.CONTEXT, patches: bool = True) -> DataFrame:
    """old and new(commit, path, content) -> DIFF_FILES of the files that differ; least: score from which on a pair is a rename, None for no renames; patches: without, they are null."""
    before, after = stored(_hashed(old), "before"), stored(_hashed(new), "after")
    newest = lambda df, name: df.groupBy("commit", "path").agg(F.max("hash").alias(name))
    both = newest(before, "old_hash").join(newest(after, "new_hash"), ["commit", "path"], "full")
    changed = stored(both.where("not (old_hash <=> new_hash)"), "changed")
    left = _texts(before, changed.where("old_hash is not null"), "old_hash").withColumnRenamed("content", "old")
    right = _texts(after, changed.where("new_hash is not null"), "new_hash").withColumnRenamed("content", "new")
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").otherwise("M")
    text, none = lambda name: F.coalesce(name, F.lit("")).alias(name), F.lit(None).cast("string").alias("old_path")
    texts = left.join(right, ["commit", "path"], "full").select("commit", "path", text("old"), text("new"), status.alias("status"))
    columns = ["commit", "path", "old_path", "status", "score", "old", "new"]
    if least is not None:
        texts = stored(texts, "texts", "status")
        gone, added = (texts.where(F.col("status") == s).select("commit", F.col("path").alias(f"{name}_path"), name) for s, name in (("D", "old"), ("A", "new")))
        content = lambda df, name: df.withColumnsRenamed({f"{name}_path": "path", name: "content"})
        found = stored(renames.renames(content(gone, "old"), content(added, "new"), least), "moved")
        pairs = found.join(gone, ["commit", "old_path"]).join(added, ["commit", "new_path"]).withColumnRenamed("new_path", "path").withColumn("status", F.lit("R"))
        rest = [content(df.join(found.select("commit", f"{name}_path"), ["commit", f"{name}_path"], "left_anti"), name).withColumn("status", F.lit(s)) for df, name, s in ((gone, "old", "D"), (added, "new", "A"))]
        texts = texts.where("status = 'M'").unionByName(rest[0].withColumnRenamed("content", "old").withColumn("new", F.lit(""))).unionByName(rest[1].withColumnRenamed("content", "new").withColumn("old", F.lit("")))
        rows = texts.withColumns({"old_path": none, "score": F.lit(1.0)}).select(columns).unionByName(pairs.select(columns))
    else:
        rows = texts.withColumns({"old_path": none, "score": F.lit(1.0)}).select(columns)
    schema = pa.schema([(n, pa.string()) for n in ("commit", "path", "old_path", "status")] + [("additions", pa.int32()), ("deletions", pa.int32()), ("patch", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared() -> Iterator[tuple]:
            for commit, path, old_path, status, score, x, y in _rows(batches):
                yield commit, path, old_path or "", status, *(linediff.patch(old_path or path, path, status, x, y, score, context) if patches else (*linediff.counts(x, y), None))

        return _flushed(compared(), schema)

    return rows.mapInArrow(run, DIFF_FILES)


def patched(files: DataFrame, diff_files: DataFrame) -> DataFrame:
    """files(commit, path, content) with the changes of DIFF_FILES: the snapshot after them.

    A patch that does not fit its file fails the job; a binary one has no content to apply and fails it, too.
    """
    before = _hashed(files).groupBy("commit", "path").agg(F.max(F.struct("hash", "content"))["content"].alias("content")).withColumnRenamed("path", "source")
    of_file = Window.partitionBy("commit", "source")
    change = diff_files.where("status is not null").select("commit", "path", F.when(F.coalesce("old_path", F.lit("")) != "", F.col("old_path")).otherwise(F.col("path")).alias("source"), "status", "patch")
    # a file stays as it is beside added ones of its path alone: one of them brings it along
    change = change.withColumn("stays", (F.max(F.col("status") != "A").over(of_file) == F.lit(False)) & (F.row_number().over(of_file.orderBy("status")) == 1))
    meets = before.join(change, ["commit", "source"], "full").where("status is null or status <> 'D'").select("commit", "source", "path", "status", "stays", "content", "patch")
    schema = pa.schema([(n, pa.string()) for n in ("commit", "path", "content")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def applied() -> Iterator[tuple]:
            for commit, source, path, status, stays, content, patch in _rows(batches):
                if content is not None and (status is None or stays):
                    yield commit, source, content
                if status is not None:
                    yield commit, path, linediff.apply(content or "", patch)

        return _flushed(applied(), schema)

    return meets.mapInArrow(run, "commit string, path string, content string")
