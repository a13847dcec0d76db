"""Exact top-k inner products by best-first search in M-trees.

Vectors x become integers floor(1024 x). One more coordinate makes all squared
norms equal, so that a larger inner product is exactly a smaller distance, which
is a metric, and the tree's triangle inequalities hold. Each partition builds its
trees of pages once and writes them to the shared folder: a node keeps its centre,
its covering radius and its distance to the parent's centre, an entry its distance
to the page's centre. From the distance query - parent, a node or entry is bounded
without computing its own distance, and the search takes the nearest bound first and
stops when no bound can beat the k-th score. Scores are integers, so results are exact.

Queries are a stated set and go to the trees in blocks of QUERY_BLOCK, one after the
other; trees return k candidates each, and ranks are made over those.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do those of another length than the most frequent one (of equally
frequent ones the least) and those whose squared integer norm is 2^62 or more, as
their scores can exceed 64 bits; empty vectors score 0; ties go to the smaller vec_id;
rows that repeat a vec_id are candidates each, and as queries are ranked together, but
a row is never a candidate of a query with its id; a null vec_id takes no part; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.storage import new_path, written

SCALE = 1024
K = 10
PAGE = 64
FANOUT = 16
#: Query vectors in one broadcast.
QUERY_BLOCK = 20_000
#: Vectors of one tree; a larger partition gets several.
TREE_VECTORS = 1 << 13
#: Added to bounds, as a share of the greatest distance: beyond the rounding of distances in double precision.
SLACK = 1e-7


class MTree:
    """Bulk-loaded by splitting at far-apart pivots. Nodes in arrays; children and pages are contiguous."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.x, self.ids = vectors, ids
        self._lift()
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.children: list[np.ndarray] = []
        self.pages: list[np.ndarray | None] = []
        self.entry_distance = np.zeros(len(ids))
        self.rng = np.random.default_rng(len(ids))
        if len(ids):
            self._build(np.arange(len(ids)), None)
        self.radius, self.to_parent = np.array(self.radius), np.array(self.to_parent)
        #: inner products computed by searches
        self.computed = 0

    def _lift(self) -> None:
        squared = (self.x * self.x).sum(axis=1)
        self.top = int(squared.max(initial=0))
        self.full = np.concatenate([self.x.astype(float), np.sqrt((self.top - squared).astype(float))[:, None]], axis=1)

    def __getstate__(self) -> dict:
        """What is written: without what follows from the vectors, and those as narrow as they are."""
        most = int(np.abs(self.x).max(initial=0))
        narrow = self.x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
        return {k: v for k, v in vars(self).items() if k not in ("full", "rng")} | {"x": narrow}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.x = self.x.astype(np.int64)
        self._lift()

    def _build(self, members: np.ndarray, parent: np.ndarray | None) -> int:
        node = len(self.centre)
        points = self.full[members]
        centre = points.mean(axis=0)
        distance = np.sqrt(((points - centre) ** 2).sum(axis=1))
        self.centre.append(centre)
        self.radius.append(float(distance.max()))
        self.to_parent.append(0.0 if parent is None else float(np.sqrt(((centre - parent) ** 2).sum())))
        self.children.append(np.zeros(0, np.int64))
        self.pages.append(None)
        if len(members) <= PAGE or distance.max() == 0:
            self.pages[node] = members[np.argsort(distance, kind="stable")]
            self.entry_distance[members] = distance
            return node
        pivots = points[self.rng.choice(len(members), min(FANOUT, len(members)), replace=False)]
        for _ in range(4):  # a few rounds of moving pivots to the middle of what is nearest
            near = ((pivots**2).sum(axis=1) - 2 * points @ pivots.T).argmin(axis=1)
            pivots = np.stack([points[near == k].mean(axis=0) if (near == k).any() else pivots[k] for k in range(len(pivots))])
        near = ((pivots**2).sum(axis=1) - 2 * points @ pivots.T).argmin(axis=1)
        groups = [members[near == k] for k in range(len(pivots)) if (near == k).any()]
        if len(groups) == 1:
            groups = np.array_split(members, FANOUT)
        self.children[node] = np.array([self._build(g, centre) for g in groups])
        return node

    def search(self, query: np.ndarray, query_id: int, k: int = K) -> list[tuple[int, int]]:
        """The k best (score, id), best first; not the query's own id."""
        if not len(self.ids):
            return []
        # the query's own lift is free: zero keeps distances smallest and order the same
        q = np.append(query.astype(float), 0.0)
        constant = float((q * q).sum()) + self.top
        slack = SLACK * np.sqrt(constant) + SLACK
        best: list[tuple[int, int]] = []  # heap of (score, -id), worst first

        def reach() -> float:
            """Distance beyond which nothing can enter; equal scores can, by a smaller id."""
            return np.sqrt(max(0.0, constant - 2.0 * best[0][0])) + slack if len(best) == k else np.inf

        root = float(np.sqrt(((self.centre[0] - q) ** 2).sum()))
        queue = [(max(0.0, root - self.radius[0]), 0, root)]
        while queue:
            bound, node, distance = heapq.heappop(queue)
            limit = reach()
            if bound > limit:
                break
            page = self.pages[node]
            if page is None:
                kids = self.children[node]
                # parent distances bound a child before its own distance is known
                kids = kids[np.abs(distance - self.to_parent[kids]) - self.radius[kids] <= limit]
                if len(kids):
                    d = np.sqrt(((np.stack([self.centre[c] for c in kids]) - q) ** 2).sum(axis=1))
                    for c, x in zip(kids.tolist(), d.tolist(), strict=True):
                        low = max(0.0, x - self.radius[c])
                        if low <= limit:
                            heapq.heappush(queue, (low, c, x))
                continue
            page = page[np.abs(distance - self.entry_distance[page]) <= limit]
            page = page[self.ids[page] != query_id]
            if not len(page):
                continue
            scores = self.x[page] @ query
            self.computed += len(page)
            if len(best) == k:
                good = scores >= best[0][0]
                page, scores = page[good], scores[good]
            for s, i in sorted(zip(scores.tolist(), (-self.ids[page]).tolist(), strict=True), reverse=True)[:k]:
                if len(best) < k:
                    heapq.heappush(best, (s, i))
                elif (s, i) > best[0]:
                    heapq.heapreplace(best, (s, i))
                else:
                    break
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part, whatever their length."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    squared = F.aggregate(x, F.lit(0.0), lambda total, c: total + F.pow(F.abs(c.cast("double")) * SCALE + 1, 2.0))
    return vectors.where(good).where(squared < 2.0**62).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))).alias("x"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(n, -1)


def write_trees(candidates: DataFrame) -> DataFrame:
    """candidates(vec_id, x), all of one length -> the written table of trees, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, size = [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(MTree(np.concatenate(x), np.concatenate(ids)))], pa.binary())], names=["tree"])

        for batch in batches:
            for s in range(0, batch.num_rows, TREE_VECTORS):
                i, v = _arrays(batch.slice(s, TREE_VECTORS))
                ids.append(i)
                x.append(v)
                size += len(i)
                if size >= TREE_VECTORS:
                    yield row()
                    x, ids, size = [], [], 0
        if size:
            yield row()

    return written(candidates.mapInArrow(run, "tree binary"), "trees")[0]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Both (vec_id, embedding) -> (query_id, rank, vec_id, score) with the k best of all vectors for each query."""
    spark = vectors.sparkSession
    vectors, asked = integer_vectors(vectors), integer_vectors(queries)
    usual = vectors.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = usual["n"] if usual else 0
    trees = write_trees(vectors.where(F.size("x") == length))
    path = new_path(spark, "answers")
    schema = "query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)

    def answer(rows: list) -> None:
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0):
                    tree, out = pickle.loads(blob.as_buffer()), []
                    for q, vector in zip(shared.value[0].tolist(), shared.value[1], strict=True):
                        out += [(q, v, s) for s, v in tree.search(vector, q, k)]
                    yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

        trees.mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.destroy()

    block: list = []
    for r in asked.where(F.size("x") == length).toLocalIterator():  # one block at a time
        block.append((r[0], r[1]))
        if len(block) >= query_block:
            answer(block)
            block = []
    if block:
        answer(block)
    found = spark.read.schema(schema).parquet(path)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_mtree_top_k(spark, sf_dir: str) -> DataFrame:
    """Contract digest: every hundredth id against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
