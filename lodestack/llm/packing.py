"""Sequence packing by non-negative least squares.

Every document is cut into full windows and a remainder. The histogram of
remainders (window - 1 bins, whatever the corpus) goes to the driver, where
shallow combinations of lengths that fill a window exactly are enumerated,
their repeat counts solved by non-negative least squares, rounded down to what
the histogram holds, and what is left is packed greedily: laid end to end,
longest first, and cut at the windows' ends. A remainder's place then follows
from its length and its rank among the remainders of that length: ranks are counted
where documents lie and shifted by counts of the partitions before, which meet the
ids in one sort-merge join by partition and length.

Defined results: null texts are empty and hold the end id alone, and so are empty
ones; very long texts fill whole windows, each a piece of its own; repeated rows and
rows of a repeated or null doc_id are packed once each; ties (remainders of equal
length) go in the order of partitions and rows; an empty table gives no rows; only
the last sequence can be short; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.storage import written
from lodestack.llm.textblock import binary_array, released
from lodestack.llm.tokens import memo_for, tokenizer_file

WINDOW = 2048
END_ID = 1
#: Lengths that combinations of three and of four are made of: the most frequent ones.
TOP_THREE, TOP_FOUR = 64, 16


def combinations(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths that fill a window exactly: all pairs, and threes and fours of frequent lengths."""
    have = np.flatnonzero(histogram)
    out = {(int(a), window - int(a)) for a in have if a * 2 <= window and histogram[window - a]}
    frequent = [int(x) for x in have[np.argsort(-histogram[have], kind="stable")]]
    three = frequent[:TOP_THREE]
    for i, a in enumerate(three):
        for b in three[i:]:
            c = window - a - b
            if 0 < c < window and histogram[c]:
                out.add(tuple(sorted((a, b, c))))
    four = frequent[:TOP_FOUR]
    for i, a in enumerate(four):
        for j, b in enumerate(four[i:], i):
            for c in four[j:]:
                d = window - a - b - c
                if d > 0 and histogram[d]:
                    out.add(tuple(sorted((a, b, c, d))))
    return sorted(out)


def non_negative_least_squares(combos: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, A holding how often a combination uses each length."""
    if not combos:
        return np.zeros(0)
    sizes = np.array([len(c) for c in combos])
    length = np.concatenate([np.array(c) for c in combos])
    column = np.repeat(np.arange(len(combos)), sizes)
    target = histogram.astype(float)
    up = lambda x: np.bincount(length, weights=x[column], minlength=len(target))
    back = lambda r: np.bincount(column, weights=r[length], minlength=len(combos))
    probe = np.ones(len(combos))
    for _ in range(30):  # largest eigenvalue of A'A bounds the step
        probe = back(up(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(up(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> dict:
    """Slots by length and the residual's layout. histogram[l]: remainders of length l."""
    combos = combinations(histogram, window)
    counts = non_negative_least_squares(combos, histogram)
    left = histogram.astype(np.int64).copy()
    slots: list[tuple[int, int, int, int, int]] = []  # length, first rank, end rank, first sequence, offset there
    used = np.zeros(len(left), np.int64)
    sequence = 0
    order = np.argsort(-counts, kind="stable")
    for exact in (False, True):  # rounded repeats first, then whatever of the same combinations still fits
        for k in order:
            combo = combos[k]
            fits = min(left[v] // combo.count(v) for v in set(combo))
            n = int(fits if exact else min(fits, np.floor(counts[k])))
            if n <= 0:
                continue
            offset = 0
            for v in combo:
                slots.append((v, int(used[v]), int(used[v]) + n, sequence, offset))
                used[v] += n
                left[v] -= n
                offset += v
            sequence += n
    start = np.zeros(len(left), np.int64)
    lengths = np.arange(len(left))
    volume = (left * lengths)[::-1]
    start[::-1] = np.cumsum(volume) - volume
    total = int((left * lengths).sum())
    slots.sort()
    return {
        "slots": np.array(slots, np.int64).reshape(-1, 5), "used": used, "stream": start, "stream_sequence": sequence,
        "sequences": sequence + -(-total // window), "combinations": len(combos), "residual": int(left.sum()), "padding": -total % window,
    }


def place(length: np.ndarray, rank: np.ndarray, p: dict, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Pieces of remainders: index, start in the remainder, length, sequence, offset."""
    slots = p["slots"]
    scale = int(max(p["used"].max(initial=0), rank.max(initial=0))) + 1
    at = np.searchsorted(slots[:, 0] * scale + slots[:, 1], length * scale + rank, side="right") - 1
    in_slot = (rank < p["used"][length]) if len(slots) else np.zeros(len(length), bool)
    i = np.flatnonzero(in_slot)
    s = slots[at[i]] if len(slots) else np.zeros((0, 5), np.int64)
    out = [(i, np.zeros(len(i), np.int64), length[i], s[:, 3] + rank[i] - s[:, 1], s[:, 4])]
    i = np.flatnonzero(~in_slot)
    begin = p["stream"][length[i]] + (rank[i] - p["used"][length[i]]) * length[i]
    first = begin // window
    head = np.minimum(length[i], (first + 1) * window - begin)
    out.append((i, np.zeros(len(i), np.int64), head, p["stream_sequence"] + first, begin % window))
    cut = np.flatnonzero(head < length[i])
    out.append((i[cut], head[cut], length[i][cut] - head[cut], p["stream_sequence"] + first[cut] + 1, np.zeros(len(cut), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _tokenised(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_for(tokenizer_file(tokenizer))
        part = TaskContext.get().partitionId()
        seen, full = np.zeros(window, np.int64), 0
        for batch in batches:
            ids, at = memo.encode(batch.column(1), end_id)
            n = np.diff(at)
            rest = n % window
            # rank among equal remainders of this partition, in row order
            order = np.argsort(rest, kind="stable")
            grouped = rest[order]
            new = np.concatenate([[True], grouped[1:] != grouped[:-1]]) if len(grouped) else np.zeros(0, bool)
            run_start = np.maximum.accumulate(np.where(new, np.arange(len(grouped)), 0))
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - run_start
            rank += seen[rest]
            seen += np.bincount(rest, minlength=window)
            before = full + np.cumsum(n // window) - n // window
            full += int((n // window).sum())
            cols = [batch.column(0), binary_array(ids.view(np.uint8), at * memo.dtype.itemsize), pa.array(n), pa.array(np.full(len(n), part, np.int64)), pa.array(before), pa.array(rest.astype(np.int32)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n", "part", "full_before", "rest", "rank"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, n long, part long, full_before long, rest int, rank long")


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32-bit; null unless with_ids)."""
    spark = docs.sparkSession
    itemsize = memo_for(tokenizer_file(tokenizer)).dtype.itemsize
    tokens, _ = written(_tokenised(docs, tokenizer, window, end_id), "ids")
    counts, _ = written(tokens.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("n") / window)).alias("full")), "counts")
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[r["rest"]] = r["n"]
    histogram[0] = 0
    layout = spark.sparkContext.broadcast(plan(histogram, window))
    n_packed = layout.value["sequences"]
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fulls = counts.groupBy("part").agg(F.sum("full").cast("long").alias("full"))
    # full windows before each partition: one number for each, summed in blocks of 1,024 partitions
    block = F.floor(F.col("part") / 1024)
    in_block = F.sum("full").over(Window.partitionBy(block).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    blocks_before, total = {}, 0
    for r in sorted(fulls.groupBy(block.alias("b")).agg(F.sum("full").alias("f")).collect(), key=lambda r: r["b"]):
        blocks_before[r["b"]], total = total, total + r["f"]
    base = F.create_map(*[F.lit(int(x)) for kv in blocks_before.items() for x in kv]) if blocks_before else F.create_map(F.lit(0), F.lit(0))
    fulls = fulls.select("part", (F.coalesce(in_block, F.lit(0)) + F.coalesce(F.element_at(base, block.cast("int")), F.lit(0))).cast("long").alias("full_shift"))
    shifts = counts.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("shift")).join(fulls, "part")
    # a sort-merge join at every size: the shifts grow with the partitions, so they are never broadcast
    joined = tokens.join(shifts.hint("shuffle_merge"), ["part", "rest"]).select("doc_id", "ids", "n", "full_before", "rest", "rank", "full_shift", "shift")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = layout.value
        dtype = np.dtype(f"<u{itemsize}")
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                yield from pieces(batch.slice(s, 2000), p, dtype)

    def pieces(batch: pa.RecordBatch, p: dict, dtype: np.dtype) -> Iterator[pa.RecordBatch]:
        doc, ids = batch.column(0), batch.column(1)
        n, full_before, rest, rank, full_shift = (batch.column(k).to_numpy() for k in range(2, 7))
        rest = rest.astype(np.int64)
        rank = rank + batch.column(7).to_numpy()
        n_full = n // window
        i1 = np.repeat(np.arange(len(n)), n_full)
        k1 = np.arange(len(i1)) - np.repeat(np.cumsum(n_full) - n_full, n_full)
        has = np.flatnonzero(rest)
        j, s2, l2, q2, o2 = place(rest[has], rank[has], p, window)
        row = np.concatenate([i1, has[j]])
        start = np.concatenate([k1 * window, (n_full * window)[has[j]] + s2])
        length = np.concatenate([np.full(len(i1), window), l2])
        sequence = np.concatenate([n_packed + (full_shift + full_before)[i1] + k1, q2])
        offset = np.concatenate([np.zeros(len(i1), np.int64), o2])
        order = np.lexsort((start, row))
        row, start, length, sequence, offset = (x[order] for x in (row, start, length, sequence, offset))
        whole = [np.frombuffer(x.as_buffer(), dtype).astype("<u4") for x in ids]
        cut = [whole[r][a : a + m].tobytes() for r, a, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
        crc = np.fromiter(map(zlib.crc32, cut), np.int64, len(cut))
        cols = [doc.take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], sequence, offset)), pa.array(cut, pa.binary()) if with_ids else pa.nulls(len(row), pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return joined.mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}, ids binary")


def op10_nnls_packing(spark, sf_dir: str) -> DataFrame:
    """Contract digest of pack() over whole documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")
