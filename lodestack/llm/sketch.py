"""Count-min sketch of a distributed set of keys, of fixed size.

Each partition counts its keys into a sparse sketch (cells that are not zero,
saturating), the partitions' sketches are merged slice by slice, and what comes
back is two bits a cell: reached twice or more, and `heavy` times or more. Counts are
never underestimated, so a key that occurs so often is always reported; others rarely.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestack.llm.storage import drop, written
from lodestack.llm.textblock import release, released

#: Cells of a row of the sketch. The merged bits take DEPTH * 2^WIDTH_BITS / 8 bytes (32 MB) and 1/32 of that, whatever the input.
WIDTH_BITS = 27
DEPTH = 2
SLICE_BITS = 21
#: Slices (4 MB as counts, 256 KB as bits) that a task merges, about.
SLICES_A_TASK = 8
#: Occurrences from which a key counts as heavy.
HEAVY = 1000
#: Neighbouring cells that share a bit for heavy ones (2^FOLD_BITS): those are few.
FOLD_BITS = 5
_MOST = (1 << 32 - SLICE_BITS) - 1
#: Keys that a partition counts at once.
FLUSH_KEYS = 1 << 21
_ROWS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def cells(keys: np.ndarray, row: int, width_bits: int = WIDTH_BITS) -> np.ndarray:
    return ((keys * _ROWS[row]) >> np.uint64(64 - width_bits)).astype(np.uint32)


def partition_sketch(keys: np.ndarray, width_bits: int = WIDTH_BITS) -> Iterator[tuple[int, bytes]]:
    """(slice, cells) of one batch of keys; a cell's upper bits say how often it was reached."""
    for row in range(DEPTH):
        at = np.sort(cells(keys, row, width_bits))
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, len(at)))
        at = at[first]
        part = at >> np.uint32(SLICE_BITS)
        low = (at & np.uint32((1 << SLICE_BITS) - 1)) | (np.minimum(count, _MOST).astype(np.uint32) << np.uint32(SLICE_BITS))
        edges = np.searchsorted(part, np.arange((1 << (width_bits - SLICE_BITS)) + 1))
        for s in np.flatnonzero(np.diff(edges)):
            yield (row << (width_bits - SLICE_BITS)) + int(s), low[edges[s] : edges[s + 1]].astype("<u4").tobytes()


def repeated_cells(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], heavy: int = HEAVY, width_bits: int = WIDTH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the cells that all keys of df reach at least twice, and at least `heavy` times (at most HEAVY): a row for each hash, of 2^width_bits cells."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, amount = [], 0

        def flush() -> pa.RecordBatch:
            parts = list(partition_sketch(np.concatenate(held), width_bits))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["slice", "cells"])

        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                amount += len(keys)
                if amount >= FLUSH_KEYS:
                    yield flush()
                    held, amount = [], 0
        if amount:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                low = np.frombuffer(blob.as_buffer(), "<u4")
                if s not in slices:
                    slices[s] = np.zeros(1 << SLICE_BITS, np.uint16)
                counts, at = slices[s], low & np.uint32((1 << SLICE_BITS) - 1)
                counts[at] = np.minimum(counts[at] + (low >> np.uint32(SLICE_BITS)).astype(np.uint16), heavy)
        for s, counts in slices.items():
            many = (counts >= heavy).reshape(-1, 1 << FOLD_BITS).any(axis=1)
            bits = [pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary()) for x in (counts >= 2, many)]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *bits], names=["slice", "bits", "heavy"])

    slices = DEPTH << (width_bits - SLICE_BITS)
    # a number of partitions that is asked for stays: few cells would all be merged in one task, and all bits come to the driver at once
    counted = df.mapInArrow(released(count), "slice int, cells binary").repartition(-(-slices // SLICES_A_TASK), "slice")
    merged, path = written(counted.mapInArrow(released(merge), "slice int, bits binary, heavy binary"), "sketch")
    twice, many = (np.zeros((slices, 1 << (SLICE_BITS - 3 - fold)), np.uint8) for fold in (0, FOLD_BITS))
    for r in merged.toLocalIterator():  # DEPTH * 64 rows at most
        twice[r["slice"]], many[r["slice"]] = np.frombuffer(r["bits"], np.uint8), np.frombuffer(r["heavy"], np.uint8)
    drop(df.sparkSession, path)
    release()
    return twice.reshape(DEPTH, -1), many.reshape(DEPTH, -1)


def reached(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """True where all the key's cells have their bit: its estimate is as high as bits (one half of repeated_cells()) ask for."""
    return _reached(keys, bits, WIDTH_BITS)


def reached_narrow(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The same for bits of repeated twice, of a sketch of any width: a cell has a bit."""
    return _reached(keys, bits, (8 * bits.shape[1]).bit_length() - 1)


def _reached(keys: np.ndarray, bits: np.ndarray, width_bits: int) -> np.ndarray:
    out = np.ones(len(keys), bool)
    fold = np.uint32(((1 << width_bits - 3) // bits.shape[1]).bit_length() - 1)
    for row in range(DEPTH):
        at = cells(keys, row, width_bits) >> fold
        out &= ((bits[row][at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & 1).astype(bool)
    return out
