"""Token ids as static range asymmetric numeral systems (rANS).

A frequency table over the whole corpus is shared by all blocks. A block holds
whole documents in ascending doc_id order and LANES interleaved states; token i
belongs to lane i mod LANES, so that a step codes one token of every lane at
once. Every CHECKPOINT steps the block keeps the lanes' states, the place in the
word stream and a checksum, so its segments decode independently of each other.

File format (a folder): `blocks`, Parquet rows in ascending order of documents,
one file a range of doc_id, holding n_tokens, start (ids in all documents before
the block), doc_id and n_tokens of its documents, states, words, places and
checksums; `table`, the frequencies by id, which sum to 2^SCALE_BITS.

Defined results: null texts are empty; every document ends with the end id; a very
long text ends the block that it reaches the size of, and that block is as long as it;
rows that repeat a doc_id follow each other in order of a hash of their text, equal rows
once each; null ids come first; an empty table gives files without rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.storage import new_path, shared_dir
from lodestack.llm.tokens import memo_for, tokenizer_file

LANES = 1024
CHECKPOINT = 128
SCALE_BITS = 20
#: Tokens in a block; a block ends with the document that reaches it.
BLOCK_TOKENS = LANES * 256
END_ID = 0
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_SCALE = np.uint64(SCALE_BITS)
_SLOT = np.uint64((1 << SCALE_BITS) - 1)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE_BITS, at least one for every id that occurs."""
    total, size = int(counts.sum()), 1 << SCALE_BITS
    if (counts > 0).sum() > size:
        raise ValueError("more ids than slots")
    if not total:
        out = np.zeros(len(counts), np.int64)
        out[0] = size
        return out
    out = np.where(counts > 0, np.maximum(1, counts.astype(float) * size / total).astype(np.int64), 0)
    short = size - int(out.sum())
    order = np.argsort(-out, kind="stable")
    while short:
        if short > 0:
            out[order[0]] += short
            break
        for i in order:  # take back from the largest
            take = min(-short, int(out[i]) - max(1, int(out[i]) // 2))
            out[i] -= max(take, 0)
            short += max(take, 0)
            if not short:
                break
    return out


class Table:
    """Frequencies with starts and the slot look-up."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int64), freq)
        self.limit = self.freq << np.uint64(63 - SCALE_BITS)


def encode(tokens: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> dict:
    """One block. Works backwards, so that decoding runs forwards."""
    n = len(tokens)
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    out: list[np.ndarray] = []
    sizes = np.zeros(steps + 1, np.int64)
    kept: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        s = tokens[t * lanes : (t + 1) * lanes]
        x = state[: len(s)]
        over = x >= table.limit[s]
        out.append((x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        sizes[t] = len(out[-1])
        x = np.where(over, x >> _32, x)
        q, r = np.divmod(x, table.freq[s])
        state[: len(s)] = (q << _SCALE) + r + table.start[s]
        if t % every == 0:
            kept[t] = state.copy()
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    before = np.concatenate([[0], np.cumsum(sizes[:-1])]) if steps else np.zeros(1, np.int64)
    marks = range(0, steps, every)
    return {
        "n_tokens": n, "lanes": lanes, "every": every, "words": words.astype("<u4").tobytes(),
        "states": b"".join(kept[t].astype("<u8").tobytes() for t in marks), "places": [int(before[t]) for t in marks],
        "checksums": [zlib.crc32(tokens[t * lanes : (t + every) * lanes].astype("<u4").tobytes()) for t in marks],
    }


def decode_segment(block: dict, table: Table, k: int) -> np.ndarray:
    """Tokens from the k-th checkpoint to the next; needs nothing of the other segments but the word stream."""
    lanes, every, n = block["lanes"], block["every"], block["n_tokens"]
    state = np.frombuffer(block["states"], "<u8", lanes, k * lanes * 8).astype(np.uint64)
    words = np.frombuffer(block["words"], "<u4")
    at = block["places"][k]
    first, last = k * every * lanes, min(n, (k + 1) * every * lanes)
    out = np.empty(last - first, np.int64)
    for i in range(0, last - first, lanes):
        m = min(lanes, last - first - i)
        x = state[:m]
        slot = x & _SLOT
        s = table.symbol[slot]
        out[i : i + m] = s
        x = table.freq[s] * (x >> _SCALE) + slot - table.start[s]
        under = np.flatnonzero(x < _LOW)
        x[under] = (x[under] << _32) | words[at : at + len(under)]
        at += len(under)
        state[:m] = x
    if zlib.crc32(out.astype("<u4").tobytes()) != block["checksums"][k]:
        raise ValueError(f"checksum of segment {k} differs")
    return out


def decode(block: dict, table: Table) -> np.ndarray:
    return np.concatenate([decode_segment(block, table, k) for k in range(len(block["places"]))] or [np.zeros(0, np.int64)])


# -- over a corpus ------------------------------------------------------------

_GROUP = "part long, first long, doc_id {id}, n array<long>, ids binary"
_BLOCKS = "start long, n_tokens long, lanes int, every int, doc_id {id}, doc_tokens array<long>, words binary, states binary, places array<long>, checksums array<long>"


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Documents in ascending order, ids of about a block's documents in one compressed row. checkpoint() keeps partitions and order."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_for(tokenizer_file(tokenizer))
        pack = zstandard.ZstdCompressor(level=3)
        part = TaskContext.get().partitionId()
        first = 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # ids of documents, their sizes, token ids
        amount = 0

        def row() -> pa.RecordBatch:
            nonlocal first
            names, sizes = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            ids = pack.compress(np.concatenate([h[2] for h in held]).tobytes())
            whole = pa.array([0, len(sizes)], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, x) for x in (names, pa.array(sizes))]
            out = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([first]), *lists, pa.array([ids], pa.binary())], names=["part", "first", "doc_id", "n", "ids"])
            first += len(sizes)
            return out

        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                names = batch.column(0).slice(s, 1000)
                ids, at = memo.encode(batch.column(1).slice(s, 1000), end_id)
                i = 0
                while i < len(names):
                    # up to the document that fills the block
                    j = min(int(np.searchsorted(at, at[i] + BLOCK_TOKENS - amount)), len(names))
                    held.append((names.slice(i, j - i), np.diff(at[i : j + 1]), ids[at[i] : at[j]]))
                    amount += int(at[j] - at[i])
                    if amount >= BLOCK_TOKENS:
                        yield row()
                        held.clear()
                        amount = 0
                    i = j
        if held:
            yield row()

    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = dealt.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return ordered.mapInArrow(run, _GROUP.format(id=f"array<{id_type}>")).checkpoint(eager=True)


def _unpacked(ids: bytes, itemsize: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), f"<u{itemsize}").astype(np.int64)


def write(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID) -> None:
    """Tokenise whole documents and write them to `path` in the format above."""
    spark = docs.sparkSession
    shared_dir(spark)
    memo = memo_for(tokenizer_file(tokenizer))
    itemsize, vocabulary = memo.dtype.itemsize, memo.tokenizer.get_vocab_size()
    grouped = _tokenised(docs, tokenizer, end_id)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part, n = np.zeros(vocabulary, np.int64), None, 0
        for batch in batches:
            for p, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = _unpacked(ids, itemsize)
                total += np.bincount(tokens, minlength=vocabulary)
                part, n = p, n + len(tokens)
        if part is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1 - part)), pa.array(np.append(total[used], n))], names=["id", "n"])

    # ids count from 0; -1 - part stands for a partition's total
    counts = np.zeros(vocabulary, np.int64)
    totals: dict[int, int] = {}
    for r in grouped.select("part", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["id"] >= 0:
            counts[r["id"]] = r["n"]
        else:
            totals[-1 - r["id"]] = r["n"]
    freq = quantise(counts)
    starts, at = {}, 0
    for p in sorted(totals):
        starts[p], at = at, at + totals[p]
    shared = spark.sparkContext.broadcast((freq, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = Table(shared.value[0]), None
        for batch in batches:
            for i in range(batch.num_rows):
                if at is None:
                    at = shared.value[1][batch.column(0)[i].as_py()]
                b = encode(_unpacked(batch.column(4)[i].as_py(), itemsize), table)
                cols = [
                    pa.array([at]), pa.array([b["n_tokens"]]), pa.array([b["lanes"]], pa.int32()), pa.array([b["every"]], pa.int32()), batch.column(2).slice(i, 1), batch.column(3).slice(i, 1),
                    pa.array([b["words"]], pa.binary()), pa.array([b["states"]], pa.binary()), pa.array([b["places"]], pa.list_(pa.int64())), pa.array([b["checksums"]], pa.list_(pa.int64())),
                ]
                at += b["n_tokens"]
                yield pa.RecordBatch.from_arrays(cols, names=["start", "n_tokens", "lanes", "every", "doc_id", "doc_tokens", "words", "states", "places", "checksums"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    blocks = grouped.mapInArrow(run, _BLOCKS.format(id=f"array<{id_type}>"))
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "id long, freq long").coalesce(1).write.parquet(f"{path}/table")


@lru_cache(maxsize=4)
def _table(freq: bytes) -> Table:
    return Table(np.frombuffer(freq, np.int64))


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, and ids (little-endian unsigned 32-bit; null unless with_ids). Segments are checked against their checksums."""
    rows = spark.read.parquet(f"{path}/table").collect()  # one row an id of the vocabulary
    freq = np.zeros(len(rows), np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    shared = spark.sparkContext.broadcast(freq.tobytes())
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _table(shared.value)
            for i in range(batch.num_rows):
                block = {name: batch.column(name)[i].as_py() for name in ("start", "n_tokens", "lanes", "every", "words", "states", "places", "checksums")}
                raw = decode(block, table).astype("<u4").tobytes()
                names, sizes = batch.column("doc_id")[i].values, batch.column("doc_tokens")[i].values.to_numpy()
                ends = np.cumsum(sizes)
                cut = [raw[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                crc = np.fromiter(map(zlib.crc32, cut), np.int64, len(cut))
                ids = pa.array(cut, pa.binary()) if with_ids else pa.nulls(len(cut), pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.array(block["start"] + ends - sizes), pa.array(sizes), pa.array(crc), ids], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    id_type = blocks.schema["doc_id"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, ids binary")


def op1_rans_token_ids(spark, sf_dir: str) -> DataFrame:
    """Contract digest: write whole documents, read the files back."""
    path = new_path(spark, "rans")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path, with_ids=False).drop("ids")
