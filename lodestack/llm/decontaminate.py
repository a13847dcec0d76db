"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of documents as they lie in a partition, so the operator needs
no shuffle: words outside the benchmark's vocabulary cannot be part of a match
and become separators, what is left is indexed, all test phrases are searched
backwards at once, and their occurrences are merged to removal spans.

A benchmark goes in blocks of BLOCK_BYTES, so neither driver nor workers hold more
than one: each block is one pass over the documents, which carries what was found
before it, and with more than one block a pass is written to the shared folder.

Defined results: null, empty or wordless texts have no words and no hits; very long
texts are treated like any others; a null or wordless item matches nothing, and an
empty benchmark leaves all as it is; items that repeat an id count once, a null id
counts as the empty string; repeated documents and null ids get results like any
others, an empty table none; other columns pass through, whatever their names, but
those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lodestack.llm.fm_index import FMIndex
from lodestack.llm.storage import written
from lodestack.llm.textblock import as_bytes, blocks, map_batches, words

WINDOW = 10
#: Bytes of benchmark text in one broadcast, whose windows take about ten times as much; a larger benchmark goes in several, one after the other.
BLOCK_BYTES = 4 << 20
#: Symbols in one index.
SHARD_SYMBOLS = 1 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SEPARATOR = np.array([c == 32 for c in _FOLD])

_RANGE = StructType().add("start", "long").add("end", "long")
SCHEMA = StructType().add("n_words", "long").add("n_hit", "long").add("spans", ArrayType(_RANGE)).add("items", ArrayType(StringType())).add("clean", "string")


def fold_words(text: str | bytes | None) -> list[bytes]:
    """Words of a text: runs of [0-9A-Za-z] and non-ASCII, A-Z lowered."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split()


def phrases(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> dict:
    """Vocabulary and windows of a block of items; an item shorter than a window is one window."""
    vocabulary: dict[bytes, int] = {}
    rows, owners, names = [], [], []
    for name, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in fold_words(text)]
        if ids:
            names.append("" if name is None else str(name))
            cut = {tuple(ids[i : i + window]) for i in range(max(1, len(ids) - window + 1))}
            rows += cut
            owners += [len(names) - 1] * len(cut)
    lengths = np.array([len(r) for r in rows], np.int64)
    table = np.zeros((len(rows), window), np.int32)
    for i, r in enumerate(rows):
        table[i, : len(r)] = r
    return {"vocabulary": vocabulary, "patterns": table, "lengths": lengths, "owners": np.array(owners, np.int64), "names": names}


def _search(symbols: np.ndarray, at: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in one shard: place of the first word, length, owner."""
    index = FMIndex(symbols, len(block["vocabulary"]) + 1)
    lo, hi = index.search(block["patterns"], block["lengths"])
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    if not len(which):
        return (np.zeros(0, np.int64),) * 3
    rows = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(len(which))
    return at[index.locate(rows)], block["lengths"][which], block["owners"][which]


def word_ids(data: np.ndarray, offsets: np.ndarray, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts' words end to end, zero for words outside the vocabulary, and n + 1 offsets. Words themselves are held for a block of texts at a time."""
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for i, j in blocks(offsets):
        split = [fold_words(data[a:b].tobytes()) for a, b in pairwise(offsets[i : j + 1].tolist())]
        sizes.append(np.fromiter(map(len, split), np.int64, len(split)))
        ids.append(np.fromiter(map(vocabulary.get, chain.from_iterable(split), repeat(0)), np.int32, int(sizes[-1].sum())))
    return np.concatenate(ids), np.cumsum(np.concatenate(sizes))


def occurrences(ids: np.ndarray, bounds: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences of a block's phrases, as places in the documents' words laid end to end, as word_ids() gives them."""
    known = np.concatenate([[0], (ids != 0).astype(np.int8), [0]])
    # a run starts where a known word follows an unknown one or a document's start
    starts = (known[1:-1] == 1) & (known[:-2] == 0)
    inner = bounds[(bounds < len(ids))]
    starts[inner] = ids[inner] != 0
    firsts = np.flatnonzero(starts)
    stops = (known[1:-1] == 1) & (known[2:] == 0)
    last = bounds[1:][bounds[1:] > 0] - 1
    stops[last] |= ids[last] != 0
    lasts = np.flatnonzero(stops) + 1
    shortest = int(block["lengths"].min(initial=1 << 30))
    keep = lasts - firsts >= shortest
    firsts, lasts = firsts[keep], lasts[keep]
    found = []
    ends = np.cumsum(lasts - firsts + 1)
    i = 0
    while i < len(firsts):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + SHARD_SYMBOLS, side="right")))
        size = lasts[i:j] - firsts[i:j] + 1
        at = np.repeat(firsts[i:j] - np.cumsum(size) + size, size) + np.arange(size.sum())
        symbols = ids[np.minimum(at, len(ids) - 1)]
        symbols[np.cumsum(size) - 1] = 0
        found.append(_search(symbols, at, block))
        i = j
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _merged(marks: np.ndarray) -> np.ndarray:
    """Maximal runs of True as rows (start, end)."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def _cut(text: bytes, spans: np.ndarray) -> str:
    starts, ends, _ = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), _SEPARATOR)
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*kept, text[at:]]).decode("utf-8", "replace")


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks, one after the other; at least one block."""
    current, size, some = [], 0, False
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        current.append((row[0], row[1]))
        size += len((row[1] or "").encode())
        if size >= block_bytes:
            yield current
            current, size, some = [], 0, True
    if current or not some:
        yield current


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs plus n_words, n_hit, spans (in words), items (sorted ids) and clean (the text without the spans; null unless with_text)."""
    spark = docs.sparkSession
    docs = docs.drop(*SCHEMA.names)
    names = [*docs.columns, *SCHEMA.names]
    text_at, width = docs.columns.index("text"), len(docs.columns)

    def one_pass(found: DataFrame, items: list) -> tuple[DataFrame, Broadcast]:
        """found: docs, with the results of the blocks before if there were any."""
        shared, again = spark.sparkContext.broadcast(phrases(items, window)), len(found.columns) > width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _searched(batch, text_at, width, again, shared.value, with_text).rename_columns(names)

        return map_batches(found, run, [*docs.schema.fields, *SCHEMA.fields]), shared

    parts = _blocks(benchmark, block_bytes)
    found, shared = one_pass(docs, next(parts))
    for items in parts:
        done, _ = written(found, "decontaminated")
        shared.destroy()
        found, shared = one_pass(done, items)
    return found


def _searched(batch: pa.RecordBatch, text_at: int, width: int, again: bool, block: dict, with_text: bool) -> pa.RecordBatch:
    data, offsets = as_bytes(batch.column(text_at))
    ids, bounds = word_ids(data, offsets, block["vocabulary"])
    cover = np.zeros(bounds[-1] + 1, np.int32)
    items: list[set[str]] = [set() for _ in range(batch.num_rows)]
    if again:
        before, names = (batch.column(width + k).to_pylist() for k in (2, 3))
        for i, spans in enumerate(before):
            items[i].update(names[i])
            for s in spans:
                cover[bounds[i] + s["start"]] += 1
                cover[bounds[i] + s["end"]] -= 1
    at, length, owner = occurrences(ids, bounds, block)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length, -1)
    row = np.searchsorted(bounds, at, side="right") - 1
    for r, o in np.unique(np.stack([row, owner], axis=1), axis=0).tolist():
        items[r].add(block["names"][o])
    hit = np.cumsum(cover, dtype=np.int32)[:-1] > 0
    spans, clean, n_hit = [], [], []
    for i in range(batch.num_rows):
        t = data[offsets[i] : offsets[i + 1]].tobytes()
        marks = hit[bounds[i] : bounds[i + 1]]
        n = int(marks.sum())
        n_hit.append(n)
        runs = _merged(marks) if n else ()
        spans.append([{"start": int(a), "end": int(b)} for a, b in runs])
        clean.append((_cut(t, runs) if n else t.decode("utf-8", "replace")) if with_text else None)
    new = [pa.array(np.diff(bounds)), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(clean, pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=[*batch.schema.names[:width], "n_words", "n_hit", "spans", "items", "clean"])


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract digest of decontaminate() over whole documents and benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(docs, benchmark, with_text=False)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, phrase)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same rows by looking at every window; for tests."""
    found: dict[tuple, set[str]] = {}
    for name, text in items:
        w = fold_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i : i + window]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w = fold_words(text)
        hit, names = set(), set()
        for n in {len(p) for p in found}:
            for i in range(len(w) - n + 1):
                if owners := found.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= owners
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out
