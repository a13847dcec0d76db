"""Toxicity by non-negative positive-unlabelled learning (numpy).

A linear model over hashed words present in a text is fitted to confirmed toxic
examples and to unlabelled text. The risk of the negatives is estimated from the
unlabelled text less the class prior's share of the positives, and held at zero
or above: where a step would drive it below, the step undoes that instead.

Labels of 0 are used for the class prior alone. The fit uses bounded samples
(POSITIVES and UNLABELLED documents on average, picked by a hash of the id);
every text is scored whole. Defined results: a null, empty or wordless text gets the
score of no words; very long texts are scored by all their distinct words; without any
toxic example, as from empty tables, all scores are 0; a null label or id teaches nothing,
and of several labels of an id the highest counts; repeated rows are scored and taught
like any others; other columns pass through, but one named score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from lodestack.llm.decontaminate import _FOLD, _SEPARATOR
from lodestack.llm.langid import held_out
from lodestack.llm.textblock import as_bytes, blocks, map_batches, span_hashes, words

FEATURE_BITS = 18
POSITIVES = 4000
UNLABELLED = 12_000
#: A word is a feature if this many toxic examples have it, and so many standard deviations more than its share of the unlabelled text lets expect.
LEAST_DOCS = 2
LEAST_EXCESS = 3.0
ROUNDS = 300
RATE = 0.05
DECAY = 1e-5
THRESHOLD = 0.7
_LOWER = np.frombuffer(_FOLD, np.uint8)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, feature) of some rows at a time: the distinct words of each text, hashed."""
    data, offsets = as_bytes(column)
    for i, j in blocks(offsets):
        part, cuts = _LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words(part, cuts, _SEPARATOR)
        row = np.repeat(np.arange(j - i), np.diff(first))
        both = np.unique((row << FEATURE_BITS) | (span_hashes(part, starts, ends) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
        yield i, j - i, both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit(positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], prior: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias. Each set: (row, feature, rows). Logistic loss, full gradients, Adam steps."""
    size = 1 << FEATURE_BITS
    seen = np.bincount(positive[1], minlength=size)
    expected = positive[2] / unlabelled[2] * np.bincount(unlabelled[1], minlength=size)
    kept = (seen >= LEAST_DOCS) & (seen - expected >= LEAST_EXCESS * np.sqrt(expected + 0.5))
    column = np.cumsum(kept) - 1
    (pr, pf, pn), (ur, uf, un) = ((r[kept[f]], column[f[kept[f]]], n) for r, f, n in (positive, unlabelled))
    k = int(kept.sum())
    w, first, second = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))

    def gradient(row: np.ndarray, col: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(col, weights=slope[row], minlength=k), slope.sum())

    for t in range(1, rounds + 1):
        zp = np.bincount(pr, weights=w[pf], minlength=pn) + w[-1]
        zu = np.bincount(ur, weights=w[uf], minlength=un) + w[-1]
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = gradient(ur, uf, _sigmoid(zu) / un) - prior * gradient(pr, pf, _sigmoid(zp) / pn)
        if as_negative >= 0:
            g = negative + prior * gradient(pr, pf, (_sigmoid(zp) - 1) / pn)
        else:
            g = -negative
        g[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(size, np.float64)
    out[kept] = w[:-1]
    return out, float(w[-1])


def _collected(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of a bounded sample, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, row, feature in features(batch.column(0)):
                cut = np.searchsorted(row, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([pa.array([feature[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["f"])

    rows = [np.frombuffer(r["f"], "<u4").astype(np.int64) for r in docs.select("text").mapInArrow(run, "f binary").collect()]
    sizes = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows) if rows else np.zeros(0, np.int64), len(rows)


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float] | None:
    """Model from documents and labels(doc_id, toxic) outside the held-out fold."""
    docs, labels = (d.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) for d in (docs, labels))
    labels = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = labels.agg(F.count("*"), F.sum("toxic")).first()
    if not n_toxic:
        return None
    picked = lambda seed, share: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < share
    ids = labels.where("toxic = 1").where(picked(1, positives / n_toxic)).select("doc_id")
    toxic = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # `positives` ids on average
    unknown = docs.select("doc_id", "text").where(picked(2, unlabelled / max(docs.count(), 1)))
    p, u = _collected(toxic), _collected(unknown)
    if not p[2] or not u[2]:
        return None
    return fit(p, u, min(max(n_toxic / n, 0.001), 0.9))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """docs plus score (0 to 1: how likely the label is 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    text_at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if shared.value is not None:
                weights, bias = shared.value
                for first, n, row, feature in features(batch.column(text_at)):
                    out[first : first + n] = _sigmoid(np.bincount(row, weights=weights[feature], minlength=n) + bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, "score"])

    return map_batches(docs, run, [*docs.schema.fields, StructField("score", DoubleType())])


def op5_nnpu_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract digest: learn outside the held-out fold, score whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
