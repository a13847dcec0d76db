"""What a change touches: line ranges of patches, and the functions that they meet.

A block of changed lines is a range (first, last) of lines as they are after the change. A block
that only removes lines is the place between two lines: its first line is the one behind
the cut and its last the one before, so that one rule serves both: a range meets a function
that starts at `last` or before and ends at `first` or behind, and a cut only a function that
is on both sides of it.

Ranges and functions meet by (repository, path, bin of BIN lines), so files with many
functions and many changes don't pair all of them, and each bin of a hot file is a key
of its own.

Defined results: null and empty patches, binary ones and lines outside of hunks touch nothing; repeated
rows count once; null paths meet nothing; a null repository meets a null one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Lines of a bin.
BIN = 64
_HEADER = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def ranges(patch: str | None) -> list[tuple[int, int]]:
    """(first, last) of each block of changed lines, in order."""
    out: list[tuple[int, int]] = []
    line, added, removed, inside = 0, 0, 0, False

    def close() -> None:
        nonlocal added, removed
        if added:
            out.append((line - added, line - 1))
        elif removed:
            out.append((line, line - 1))
        added = removed = 0

    for text in (patch or "").split("\n"):
        if header := _HEADER.match(text):
            close()
            # a hunk without lines behind it starts after the line it names
            line, inside = int(header[1]) + (header[2] == "0"), True
        elif not inside:
            continue
        elif text.startswith("+"):
            line, added = line + 1, added + 1
        elif text.startswith("-"):
            if added:
                close()
            removed += 1
        elif text.startswith(" "):
            close()
            line += 1
        elif not text.startswith("\\"):
            close()
            inside = False
    close()
    return out


def changed_ranges(diff_files: DataFrame) -> DataFrame:
    """diff_files(commit, path, patch[, repo_id]) -> (commit, path[, repo_id], first, last)."""
    keys = [c for c in ("commit", "path", "repo_id") if c in diff_files.columns]
    schema = StructType([*(diff_files.schema[c] for c in keys), *StructType().add("r", ArrayType(StructType().add("first", "integer").add("last", "integer")))])
    element = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"first": a, "last": b} for a, b in ranges(p)] for p in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, element)], names=schema.names)

    return diff_files.select(*keys, "patch").mapInArrow(run, schema).select(*keys, F.explode("r").alias("r")).select(*keys, "r.first", "r.last")


def touched_functions(functions: DataFrame, diff_files: DataFrame, once: bool = True) -> DataFrame:
    """functions(repo_id, file_path, start_line, end_line, ...) that a change meets, with its commit; a function once for each commit, or as often as they meet."""
    changed = changed_ranges(diff_files)
    with_repo = "repo_id" in changed.columns
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN))).alias("bin")
    keys = ["commit", "path", *(["repo_id"] if with_repo else [])]
    right = changed.select(*[F.col(c).alias(f"change_{c}") for c in keys], "first", "last", bins(F.least("first", "last"), F.greatest("first", "last"))).withColumnRenamed("bin", "change_bin")
    left = functions.select(F.struct("*").alias("f"), bins(F.col("start_line"), F.greatest("start_line", "end_line")))
    meets = (F.col("f.file_path") == F.col("change_path")) & (F.col("bin") == F.col("change_bin")) & (F.col("f.start_line") <= F.col("last")) & (F.col("f.end_line") >= F.col("first"))
    if with_repo:
        meets &= F.col("f.repo_id").eqNullSafe(F.col("change_repo_id"))
    out = left.join(right, meets).select(F.col("change_commit").alias("commit"), "f.*")
    return out.distinct() if once else out
