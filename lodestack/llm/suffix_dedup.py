"""Suffix-array dedup: every byte is removed that a `length`-byte string covers which also starts earlier.

Texts are UTF-8 bytes; matches never cross documents and are judged on the
input. Suffixes that can take part (see repeats.py) are sorted bucket by bucket
with a difference cover (see difference_cover.py); neighbours in suffix order
that share `length` bytes are the repeats.

Defined results: null texts are empty; texts shorter than `length` bytes lose
nothing; very long texts are treated like any others (a block of their own); of rows
that repeat id and text each gets the same result; a null doc_id counts as smaller
than all others; an empty table gives no rows; other columns pass through, whatever
their names, but those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.llm.difference_cover import equal_prefix_classes
from lodestack.llm.repeats import Level, segments, spans_of, spans_to_remove, with_spans
from lodestack.llm.sketch import HEAVY
from lodestack.llm.textblock import as_bytes, gather, map_batches, mix, random_words, span_hashes

LENGTH = 100
PIECE = 32
#: Windows of a heavy anchor that travel together: what they do not share is so short that it takes few values.
PORTION = 3
_BYTES = random_words(256, 31)
_FACTORS = random_words(5, 32) | np.uint64(1)


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the PIECE bytes from each position, by doubling."""
    h, width = _BYTES[data], 1
    for factor in _FACTORS:
        h, width = h[:-width] * factor + h[width:], 2 * width
    return mix(h)


def _cut(length: int):
    def cut(data: np.ndarray, offsets: np.ndarray):
        hashes = _piece_hashes(data) if len(data) >= length else np.zeros(0, np.uint64)
        return segments(hashes, length, PIECE, offsets), offsets, lambda a, b: gather(data, a, b - a + length), lambda a, b: span_hashes(data, a, b)

    return cut


def _judge(length: int):
    def judge(payloads: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer(b"".join(payloads), np.uint8)
        sizes = np.array([len(p) for p in payloads])
        windows = sizes - length + 1
        inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        cls = equal_prefix_classes(text, np.repeat(np.cumsum(sizes) - sizes, windows) + inner, length)
        doc, at = np.repeat(docs, windows), np.repeat(starts, windows) + inner
        order = np.lexsort((at, doc, cls))
        c = cls[order]
        first = np.concatenate([[True], c[1:] != c[:-1]])
        leader = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        earlier = np.empty(len(cls), bool)
        earlier[order] = (doc[leader] != doc[order]) | (at[leader] != at[order])
        return earlier, windows

    return judge


ADDED = StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "string")


def byte_level(length: int = LENGTH, heavy: int = HEAVY) -> Level:
    if length < 40:
        raise ValueError("length must be 40 or more")
    return Level(length, PORTION, _cut(length), _judge(length), lambda sizes: sizes - length + 1, heavy=heavy)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True, heavy: int = HEAVY) -> DataFrame:
    """docs plus n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes as text, broken characters left out; null unless with_text)."""
    docs = docs.drop(*ADDED.names)
    names = docs.columns
    joined = with_spans(docs, spans_to_remove(docs, byte_level(length, heavy)))
    text_at, spans_at = joined.columns.index("text"), len(joined.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(text_at))
            removed, n_spans, sha, kept = [], [], [], []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                spans = spans_of(batch.column(spans_at), i)
                if len(spans):
                    edges = [0, *spans.ravel().tolist(), len(raw)]
                    raw = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                removed.append(int((spans[:, 1] - spans[:, 0]).sum()))
                n_spans.append(len(spans))
                sha.append(hashlib.sha256(raw).hexdigest())
                kept.append(raw.decode("utf-8", "ignore") if with_text else None)
            new = [pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:spans_at], *new], names=[*names, *ADDED.names])

    return map_batches(joined, run, [*docs.schema.fields, *ADDED.fields])


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract digest of remove_repeats() over whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same rows by a table of all strings, for tests."""
    texts = [(d, (t or "").encode()) for d, t in docs]
    first: dict[bytes, tuple] = {}
    for d, t in sorted(texts, key=lambda x: x[0]):
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            first[s] = min(first.get(s, (d, i)), (d, i))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < (d, i):
                gone[i : i + length] = True
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out.append((d, len(t), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out
