"""Numpy views of Arrow string columns, shared by the byte- and word-level operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one vectorised step works on, so memory doesn't follow the batch.
BLOCK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
#: Of glibc; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; memory that it has freed goes back to the machine when a task ends. Workers live on from task to task, and the allocators would keep it."""

    @wraps(run)  # plans show its name
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: list[StructField]) -> DataFrame:
    """df.mapInArrow(released(run)) to columns `fields`. Columns go in by place, as c0, c1 and so on: PySpark would look them up by names, which dots and backticks break."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(released(run), StructType(fields))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about `limit` bytes; a longer row is a block of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def random_words(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, _MASK, n, dtype=np.uint64, endpoint=True)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base mod 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTE = {k: random_words(256, 1000 + k) for k in range(2)}
_POWERS = {k: Powers(b) for k, b in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))}


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hash of each data[start:end], from one running polynomial sum."""
    up, down = _POWERS[kind].get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[kind][data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(items: np.ndarray, width: int, kind: int = 0) -> np.ndarray:
    """64-bit hash of every `width` consecutive items (uint64)."""
    n = len(items)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _POWERS[kind].get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(items * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1] + np.uint64(width))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[s : s + n] of all pairs end to end, and the offsets."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])], offsets


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary column of the pieces that offsets cut data into."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and for each row the index of its first word (n + 1 values)."""
    sep = separator[data]
    begins = np.empty(len(data) + 1, bool)
    begins[0], begins[-1] = True, True
    begins[1:-1] = sep[:-1]
    begins[offsets] = True
    inside = np.concatenate([~sep, [False]])
    starts = np.flatnonzero(begins & inside)
    stops = np.concatenate([sep, [True]])
    ends_at = np.flatnonzero((stops[1:] | begins[1:]) & inside[:-1]) + 1
    return starts, ends_at, np.searchsorted(starts, offsets)
