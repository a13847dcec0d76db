"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints at Hamming distance `radius` or less are linked. 2^(radius+1) - 1
structured masks, each a linear function of a vector dealt to every bit, cover
all sets of `radius` bits: for any such set one mask avoids it, so every pair
within the radius collides in some table and none is lost.

Copies collapse to one fingerprint before any table is built. A bucket of up to
SMALL_BUCKET fingerprints is compared pair by pair; a larger one goes through
keys that its members share exactly when they are within the radius (all values
at half the radius), where a star to the least member stands for the pairs, so
no bucket's work is quadratic.

Defined results: null and wordless texts have fingerprint zero and are linked
like any others; fewer words than a shingle make one shingle; a null doc_id
takes part but is never a component's name while another id is there; very long texts
are treated like any others; repeated rows each get the same result; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.components import connected_components
from lodestack.llm.storage import written
from lodestack.llm.textblock import as_bytes, released

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
SMALL_BUCKET = 16
_SLICE = 1 << 16
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANE = 256 * np.arange(8)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = max(1, len(words) - shingle + 1)
    ends = (starts[min(shingle, len(words)) :] - 1)[:n].tolist()
    begins = starts[:n].tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, _SLICE):
        pieces = [joined[a:b] for a, b in zip(begins[i : i + _SLICE], ends[i : i + _SLICE], strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
        lanes = h.view(np.uint8).reshape(-1, 8) + _LANE
        ones += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp); fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            fps = np.fromiter((fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks of which, for any `radius` bits, at least one has none of them."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links_within(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct(fp) -> links(u, v) whose components are those of all pairs within the radius."""
    if radius % 2:
        raise ValueError("radius must be even")
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(covering_masks(radius))])
    rows = distinct.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared, _ = written(rows.join(sizes, ["t", "key"]), "buckets")
    small = shared.where(F.col("n") <= SMALL_BUCKET)
    other = small.select("t", "key", F.col("fp").alias("v"))
    pairs = small.join(other, ["t", "key"]).where((F.col("fp") < F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= radius)).select(F.col("fp").alias("u"), "v")
    flips = [_signed(sum(1 << i for i in c)) for k in range(radius // 2 + 1) for c in combinations(range(BITS), k)]
    large = shared.where(F.col("n") > SMALL_BUCKET).select("fp").distinct()
    near = large.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda f: f.bitwiseXOR(F.col("fp")))).alias("at"))
    least = near.groupBy("at").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(least, "at").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp, component_id (least doc_id of its component)."""
    prints, _ = written(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps, _ = written(connected_components(links_within(distinct.select("fp"), radius)), "components")
    named = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print, _ = written(named.join(names, "component").select("fp", "component_id"), "names")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def op8_simhash_covering_lsh(spark, sf_dir: str) -> DataFrame:
    """Contract digest of near_duplicates() over whole documents."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple[int, str | None]], radius: int = RADIUS, shingle: int = SHINGLE) -> list[tuple]:
    """The same rows from all pairs, for tests."""
    prints = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        pieces = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(p, seed=SEED) for p in pieces]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [(d, f"{p:016x}", min(docs[j][0] for j in range(len(docs)) if label[j] == label[i])) for i, ((d, _), p) in enumerate(zip(docs, prints, strict=True))]
