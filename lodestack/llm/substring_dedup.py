"""Substring dedup on words: every word is removed that a `length`-word window covers which also starts in a document with a smaller doc_id.

Words are runs of non-white-space bytes, unchanged; windows are judged on the
input. The count-min prefilter (sketch.py) counts, for each window, the anchor
shingle that stands for it: a count no smaller than the window's own, so no
repeated window is lost. The second pass groups the windows estimated repeated
exactly, by 128 bits of their words.

Defined results: null, empty and wordless texts have no words and keep nothing;
texts of fewer words than a window lose nothing; very long texts are treated like
any others; of rows that repeat id and text each gets the same result, and of rows
that share an id alone none removes from the other; a null doc_id counts as smaller
than all others; an empty table gives no rows; other columns pass through, whatever
their names, but those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lodestack.llm.repeats import Level, segments, spans_of, spans_to_remove, with_spans
from lodestack.llm.sketch import HEAVY
from lodestack.llm.textblock import as_bytes, gather, map_batches, run_hashes, span_hashes, words

LENGTH = 13
SHINGLE = 5


def _cut(length: int, shingle: int):
    def cut(data: np.ndarray, offsets: np.ndarray):
        starts, ends, firsts = words(data, offsets)
        low = span_hashes(data, starts, ends, 0)
        high = span_hashes(data, starts, ends, 1)

        def digests(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            both = np.stack([run_hashes(low, length, 0), run_hashes(high, length, 2)], axis=1).view(np.uint8).reshape(-1, 16)
            picked, cuts = gather(both, a, b - a + 1)
            return picked.ravel(), cuts * 16

        # a portion is one window
        return segments(run_hashes(low, shingle, 2), length, shingle, firsts), firsts, digests, lambda a, _: run_hashes(low, length, 0)[a]

    return cut


def _judge(payloads: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    digest = np.frombuffer(b"".join(payloads), "<u8").reshape(-1, 2)
    windows = np.array([len(p) // 16 for p in payloads])
    doc = np.repeat(docs, windows)
    order = np.lexsort((doc, digest[:, 1], digest[:, 0]))
    d = digest[order]
    first = np.concatenate([[True], np.any(d[1:] != d[:-1], axis=1)])
    leader = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    earlier = np.empty(len(doc), bool)
    earlier[order] = doc[leader] < doc[order]
    return earlier, windows


ADDED = StructType().add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "string")


def word_level(length: int = LENGTH, shingle: int = SHINGLE, heavy: int = HEAVY) -> Level:
    return Level(length, 1, _cut(length, shingle), _judge, lambda sizes: sizes // 16, same_document=False, heavy=heavy)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True, heavy: int = HEAVY) -> DataFrame:
    """docs plus n_words, n_removed, kept_sha256, and kept (the remaining words joined by blanks; null unless with_text)."""
    docs = docs.drop(*ADDED.names)
    names = docs.columns
    joined = with_spans(docs, spans_to_remove(docs, word_level(length, heavy=heavy)))
    text_at, spans_at = joined.columns.index("text"), len(joined.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(text_at))
            n_words, removed, sha, kept = [], [], [], []
            for i in range(batch.num_rows):
                split = data[offsets[i] : offsets[i + 1]].tobytes().split()
                n_words.append(len(split))
                spans = spans_of(batch.column(spans_at), i)
                for a, b in spans[::-1].tolist():
                    del split[a:b]
                removed.append(n_words[-1] - len(split))
                raw = b" ".join(split)
                sha.append(hashlib.sha256(raw).hexdigest())
                kept.append(raw.decode("utf-8", "replace") if with_text else None)
            new = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:spans_at], *new], names=[*names, *ADDED.names])

    return map_batches(joined, run, [*docs.schema.fields, *ADDED.fields])


def op6_countmin_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract digest of remove_repeats() over whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM p JOIN f USING (s) WHERE least < doc_id
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
