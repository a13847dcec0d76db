"""Ranked lexical search by sort-based accumulation.

Items go through in blocks of terms. Of each document the terms of a block's vocabulary
are found by 128-bit hashes and written as arrays of (term, occurrences), beside its number of
terms; numbers of documents with a term, of documents and of all terms come from that
table. Then, for some documents at a time, the impacts of all their terms on all items
that hold them are put end to end as (item, document, impact), sorted by radix on one
packed key of item and document, summed by `reduceat`, and each item keeps its k best in
a heap. What the tasks keep is range-partitioned by item and score, cut to k for each item
in a partition, and ranked.

An item that many documents match is neither a group nor a join key: it leaves a task with
k rows at most. Sums are 64-bit integers, so the order of additions can't show.

Defined results: null texts and texts without a term are no documents and no items; rows that share an
item_id are one item with the terms of all, and a null item_id is one as well; each row of
documents ranks by itself, those of equal scores by ascending doc_id, null last; texts of any
length count whole; empty tables give no rows; other columns don't matter, whatever
their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lodestack.llm.storage import drop, written
from lodestack.llm.textblock import as_bytes, blocks, released, span_hashes, words

TOP = 10
#: Terms of items (repeats within an item aside) that one pass over the documents serves. 16 bytes each are broadcast.
BLOCK_TERMS = 1 << 18
#: Impacts that are sorted at once.
IMPACTS = 1 << 21

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: rows [i, j), two hashes of each term, A-Z folded, and for each text the index of its first term."""
    data, offsets = as_bytes(column)
    for i, j in blocks(offsets):
        raw, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        folded = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        starts, ends, first = words(folded, cuts, _SEPARATOR)
        yield i, j, span_hashes(folded, starts, ends, 0), span_hashes(folded, starts, ends, 1), first


def item_terms(items: DataFrame) -> DataFrame:
    """items(item_id, text) -> (item_id, h0, h1, times): the distinct terms of each item as two hashes."""
    schema = StructType([items.schema["item_id"], *(StructField(c, LongType()) for c in ("h0", "h1"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h0, h1, first in _terms(batch.column(1)):
                owner = pa.array(i + np.repeat(np.arange(j - i), np.diff(first)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(h0.view(np.int64)), pa.array(h1.view(np.int64))], schema=pa.schema([batch.schema.field(0), ("h0", pa.int64()), ("h1", pa.int64())]))

    return items.select("item_id", "text").mapInArrow(released(run), schema).groupBy("item_id", "h0", "h1").agg(F.count("*").alias("times"))


class Block:
    """Some items: their vocabulary, and for each term the items that hold it."""

    def __init__(self, item: np.ndarray, h0: np.ndarray, h1: np.ndarray, times: np.ndarray):
        order = np.lexsort((item, h1, h0))
        item, h0, h1 = item[order], h0[order], h1[order]
        new = np.ones(len(h0), bool)
        new[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])
        self.h0, self.h1 = h0[new], h1[new]
        self.first = np.append(np.flatnonzero(new), len(h0))
        self.items, self.times = item, times[order]

    def find(self, h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
        """Number of each term, or -1. Of terms that share the first hash, which are next to never two, each is tried."""
        out = np.full(len(h0), -1, np.int64)
        if not len(self.h0):
            return out
        at, todo = np.searchsorted(self.h0, h0), np.arange(len(h0))
        while len(todo):
            here = np.minimum(at, len(self.h0) - 1)
            same = (at < len(self.h0)) & (self.h0[here] == h0[todo])
            hit = same & (self.h1[here] == h1[todo])
            out[todo[hit]] = here[hit]
            todo, at = todo[same & ~hit], at[same & ~hit] + 1
        return out


POSTINGS = StructType([StructField("n", LongType()), StructField("terms", BinaryType()), StructField("times", BinaryType())])


def _postings(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, terms, times): documents with a term; little-endian 32-bit numbers of those that the block has, and their occurrences."""
    schema = StructType([docs.schema["doc_id"], *POSTINGS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h0, h1, first in _terms(batch.column(1)):
                n, term = np.diff(first), shared.value.find(h0, h1)
                owner = np.repeat(np.arange(j - i), n)[term >= 0]
                pairs, times = np.unique((owner << 32) | term[term >= 0], return_counts=True)
                cut = 4 * np.searchsorted(pairs >> 32, np.arange(j - i + 1))
                lists = [pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(x.astype("<u4"))]) for x in (pairs & 0xFFFFFFFF, times)]
                whole = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), *lists], names=schema.names)
                yield whole.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(released(run), schema)


def _frequencies(postings: DataFrame, n_terms: int) -> np.ndarray:
    """Number of documents with each term of the block: counted in tasks, summed by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(as_bytes(batch.column(0))[0].view("<u4"), minlength=n_terms)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    # no more rows than the block has terms
    for term, df in postings.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def radix_order(keys: np.ndarray, top: int) -> np.ndarray:
    """Order of unsigned keys up to `top`, by stable passes over their 16-bit digits from the lowest."""
    order = np.arange(len(keys))
    for shift in range(0, max(top, 1).bit_length(), 16):
        digit = ((keys[order] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def accumulated(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score) in order of item and document: the sums of impacts of each pair."""
    if not len(item):
        return item, doc, impact
    keys = item * n_docs + doc
    order = radix_order(keys, int(keys.max()))
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first] // n_docs, keys[first] % n_docs, np.add.reduceat(impact[order], first)


class Best:
    """The k best (score, doc_id) of each item; ties to the smaller id, null last."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def add(self, item: int, scores: np.ndarray, docs: pa.Array) -> None:
        heap = self.heaps.setdefault(item, [])
        if len(heap) == self.k:
            scores, docs = _filtered(scores, docs, scores >= heap[0][0])
        if len(scores) > self.k:
            scores, docs = _filtered(scores, docs, scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
        for score, doc in zip(scores.tolist(), docs.to_pylist(), strict=True):
            entry = (score, _Last(doc))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif heap[0] < entry:
                heapq.heapreplace(heap, entry)


class _Last:
    """An id in reverse order, null before all."""

    __slots__ = ("doc",)

    def __init__(self, doc):
        self.doc = doc

    def __lt__(self, other: _Last) -> bool:
        if self.doc is None or other.doc is None:
            return self.doc is None and other.doc is not None
        return self.doc > other.doc

    def __eq__(self, other: object) -> bool:
        return self.doc == other.doc


def _filtered(scores: np.ndarray, docs: pa.Array, mask: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    return scores[mask], docs.filter(pa.array(mask))


def _impacts(n: np.ndarray, terms: np.ndarray, times: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of each (document, term): w * ((10^9 tf) div (1000 tf + 8 m)) with the document's m = 25 + (75 n N) div L."""
    sizes, which = np.unique(n, return_inverse=True)
    m = np.array([25 + 75 * x * n_docs // n_terms for x in sizes.tolist()], np.int64)[which]  # Python's integers have no end
    return weight[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[owner]))


def _scored(postings: DataFrame, shared, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best of each task."""
    schema = StructType([StructField("item", LongType()), postings.schema["doc_id"], StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, kind = shared.value, Best(top), None
        spread = np.diff(block.first)
        for batch in batches:
            kind, docs, n = batch.schema.field(0).type, batch.column(0), batch.column(1).to_numpy()
            terms, at = as_bytes(batch.column(2))
            terms, times, at = terms.view("<u4").astype(np.int64), as_bytes(batch.column(3))[0].view("<u4").astype(np.int64), at // 4
            owner = np.repeat(np.arange(len(n)), np.diff(at))
            impact = _impacts(n, terms, times, owner, weight, n_docs, n_terms)
            load = np.concatenate([[0], np.cumsum(spread[terms])])[at]
            i = 0
            while i < len(n):  # some documents at a time
                j = max(i + 1, int(np.searchsorted(load, load[i] + IMPACTS, side="right")) - 1)
                a, b = at[i], at[j]
                rows, parts = spread[terms[a:b]], block.first[terms[a:b]]
                where = np.repeat(parts - np.cumsum(rows) + rows, rows) + np.arange(rows.sum())
                item, doc, score = accumulated(block.items[where], np.repeat(owner[a:b] - i, rows), np.repeat(impact[a:b], rows) * block.times[where], j - i)
                doc, item, score = doc[score > 0], item[score > 0], score[score > 0]
                cut = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]])) if len(item) else np.zeros(1, int)
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    best.add(int(item[x]), score[x:y], docs.take(pa.array(i + doc[x:y])))
                i = j
        if kind is not None:
            flat = [(item, e[1].doc, e[0]) for item, heap in best.heaps.items() for e in heap]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], kind), pa.array([r[2] for r in flat], pa.int64())], names=schema.names)

    return postings.mapInArrow(released(run), schema)


def _cut(rows: DataFrame, top: int) -> DataFrame:
    """The best of each item: first within ranges of item and score, so that many tasks' rows of one item don't meet in one group."""
    order = [F.col("item"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, seen = None, 0
        for batch in batches:
            items = batch.column(0).to_numpy()
            if not len(items):
                continue
            new = np.concatenate([[items[0] != item], items[1:] != items[:-1]])
            # an item that began in the batch before began so many rows ago
            starts = np.concatenate([[-seen], np.flatnonzero(new)])
            place = np.arange(len(items)) - starts[np.cumsum(new)]
            item, seen = items[-1], int(place[-1]) + 1
            yield batch.filter(pa.array(place < top))

    few = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order[1:]))
    return few.withColumn("rank", rank).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (item_id, rank, doc_id, score): the best documents of each item with a score above 0."""
    spark = docs.sparkSession
    found, _ = written(item_terms(items), "item_terms")
    # numbers of items; a block is some of them in a row, so that its terms are about block_terms
    named, _ = written(found.groupBy("item_id").agg(F.count("*").alias("size")).withColumn("item", F.monotonically_increasing_id()), "items")
    total = named.agg(F.sum("size")).first()[0] or 0
    n_blocks = -(-total // block_terms)
    keyed = found.join(named.withColumnRenamed("item_id", "name").hint("shuffle_merge"), F.col("item_id").eqNullSafe(F.col("name")))
    keyed, _ = written(keyed.select("item", "h0", "h1", "times", F.pmod(F.xxhash64("item"), F.lit(max(n_blocks, 1))).alias("block")), "keyed")
    size, parts = None, []
    for b in range(n_blocks):
        rows = keyed.where(F.col("block") == b).select("item", "h0", "h1", "times").toArrow()
        block = Block(*(rows.column(c).to_numpy() if k in (0, 3) else rows.column(c).to_numpy().view(np.uint64) for k, c in enumerate(("item", "h0", "h1", "times"))))
        shared = spark.sparkContext.broadcast(block)
        postings, path = written(_postings(docs, shared), "postings")
        if size is None:
            size = postings.agg(F.count("*"), F.sum("n")).first()
        if size[0]:
            weight = weights(_frequencies(postings, len(block.h0)), size[0])
            best, _ = written(_scored(postings, shared, weight, size[0], size[1], top), "best")
            parts.append(best)
        shared.destroy()
        drop(spark, path)
    schema = StructType([items.schema["item_id"], StructField("rank", LongType()), docs.schema["doc_id"], StructField("score", LongType())])
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    ranked = _cut(rows, top).withColumnRenamed("item", "i")
    out = ranked.join(named.select(F.col("item").alias("i"), "item_id"), "i")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_sorted_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL
), size AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0
), p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), size
), i AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS impact FROM p JOIN f USING (term), size
), s AS (SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL
), r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
