"""Near-duplicate texts: SimHash candidates by covering LSH, then all that share a rare shingle, confirmed on five-word shingles.

Two texts are linked if their sets of five-word shingles have Jaccard similarity THRESHOLD
or more, whatever the edits and the length; groups are the components of all such
links, and no such link is lost. The steps:

1. A count-min sketch tells which shingles two documents or more hold. A text can only
   have a similar one if most of its shingles are among those, all but the share that
   THRESHOLD leaves; shingles of other texts are not kept. Where the shingles would fill the sketch,
   sketches of one class of them at a time rule texts out first.
2. Of those texts, fingerprints of the sets of single words (FINGERPRINTS of 64 bits) meet in
   the tables of a cover: all pairs RADIUS bits apart or less in any of them share a bucket.
   In a bucket of up to COMPARE texts each is linked with one of those before it, in a larger
   one with its neighbour in order of fingerprint. That
   finds most links of large groups at a cost that grows with the texts, and none that
   is found there has to be found again.
3. Contiguous edits move a fingerprint further than the similarity says. So texts meet again
   by the shingles of their prefixes: of all sets in one order, any two of similarity
   THRESHOLD share a shingle among the first of each. The order begins with the shingles that
   the sketch gives the fewest documents. Only shingles that prefixes of different
   components hold are dealt, and in a bucket only texts of different components are
   compared: a pair is ruled out by the sets' sizes and the shared shingle's places, or by
   the parities of the sets, which no similar pair can fail. A first round decides, for each text
   and other component of a bucket, the pair whose parities are closest; a second
   one all pairs of what are different components still.

Pairs are decided by all their shingles' hashes (64 bits). Copies collapse to one text before
anything else; texts are told apart by 128 bits.

Defined results: null texts are empty, and empty or wordless texts without any other
difference are copies of each other; fewer words than a shingle make one shingle; very
long texts are treated like any others; repeated rows are copies; a null doc_id is never
the one that names a group while another id is there; ties between documents of one id
go to the least hash of the text; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lodestack.llm.components import connected_components
from lodestack.llm.simhash import _BYTE_BITS, _LANE, covering_masks
from lodestack.llm.sketch import reached, reached_narrow, repeated_cells
from lodestack.llm.storage import written
from lodestack.llm.textblock import as_bytes, blocks, mix, random_words, released, run_hashes, span_hashes, words

RADIUS = 3
FINGERPRINTS = 6
SHINGLE = 5
THRESHOLD = 0.8
#: Texts that are compared at once, and the most of a bucket in which all are.
COMPARE = 256
#: Documents of one shingle from which it counts as common, and comes last in the order of prefixes.
COMMON = 16
#: Shingles that a sketch counts at once where one has no room for all, and letters of a text for each, about.
CLASS_KEYS = 1 << 26
LETTERS = 6
#: Classes up to which one sketch is enough, and the share of the classes that are counted beyond.
ONE_SKETCH = 3
CLASS_SHARE = 0.4
#: Bits of the width of the sketch of buckets that several components share.
BUCKET_BITS = 24
#: Words of 64 parities of a set of shingles.
PARITIES = 8
#: Texts whose bits are counted at once.
_TEXTS = 500
#: Pairs that leave a task at once.
_PAIRS = 1 << 16
#: Products of the threshold and a whole number are not exact.
_SLACK = 1e-9


_SALTS = random_words(FINGERPRINTS, 77)


def word_set_fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[text, fingerprint]: SimHashes of the distinct words' hashes of texts; zero for none. first: each text's first word, and the end."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((hashes, text))
    h, text = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    size = np.bincount(text, minlength=n)
    out = np.zeros((n, FINGERPRINTS), np.uint64)
    for a in range(0, n, _TEXTS):
        m = min(_TEXTS, n - a)
        i, j = np.searchsorted(text, (a, a + m))
        place = _LANE + 2048 * (text[i:j, None] - a)
        for k, salt in enumerate(_SALTS):
            lanes = mix(h[i:j] ^ salt).view(np.uint8).reshape(-1, 8) + place
            seen = np.bincount(lanes.ravel(), minlength=2048 * m).reshape(m, 8, 256)
            ones = (seen.astype(np.float32) @ _BYTE_BITS.astype(np.float32)).reshape(m, 64)
            out[a : a + m, k] = np.packbits(2 * ones > size[a : a + m, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of each text's shingles, repeats included; fewer words than a shingle make one, none none."""
    runs = run_hashes(hashes, shingle, 2)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(runs[a : b - shingle + 1] if b - a >= shingle else run_hashes(hashes[a:b], max(b - a, 1), 2))
    return out


def text_key() -> Column:
    """Hash of a row's text that needs no Python; null is empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """Blocks of texts: bytes, offsets, number of the first text, hashes of the folded words, and for each text the index of its first word."""
    data, offsets = as_bytes(column)
    for i, j in blocks(offsets):
        raw, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        folded = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        starts, ends, first = words(folded, cuts)
        yield raw, cuts, i, span_hashes(folded, starts, ends), first


def _profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text_hash, text_hash2, fps)"""
    schema = StructType([docs.schema["doc_id"], *(StructField(c, LongType()) for c in ("text_key", "text_hash", "text_hash2")), StructField("fps", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, cuts, i, hashes, first in _words(batch.column(1)):
                n = len(cuts) - 1
                whole = [xxhash.xxh128_intdigest(raw[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                halves = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in ([w & (2**64 - 1) for w in whole], [w >> 64 for w in whole])]
                fps = word_set_fingerprints(hashes, first).view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fps) + 1, FINGERPRINTS, dtype=np.int32)), pa.array(fps))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(2).slice(i, n), *halves, lists], names=schema.names)

    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(released(run), schema)


def doc_key() -> Column:
    """Hash of an id and its text's hash, null or not."""
    return F.xxhash64("doc_id", text_key())


def shared_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bits of a sketch: shingles that two documents or more hold, and COMMON or more."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, _, hashes, first in _words(batch.column(0)):
            yield np.concatenate([np.zeros(0, np.uint64), *(np.unique(h) for h in shingle_hashes(hashes, first))])

    return repeated_cells(docs.select("text"), keys, COMMON)


def n_classes(docs: DataFrame) -> int:
    """In how many classes by hash shingles go, so that a sketch has CLASS_KEYS of one class at most, about."""
    letters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-letters // (LETTERS * CLASS_KEYS)))


def candidates_of(docs: DataFrame, threshold: float = THRESHOLD, classes: int | None = None) -> DataFrame:
    """Of docs(doc_id, text) those that can have a similar one. Where one sketch has room for all shingles that is left to it, and all are returned.

    Otherwise a sketch of one class of shingles at a time counts those that a text has alone, and a text goes of which more are
    alone than THRESHOLD leaves. What it says is bounded from one side: shingles of classes that are not counted, and those that share
    a cell, count as shared. Classes up to CLASS_SHARE of all are enough for texts that share little; further ones change little."""
    classes = n_classes(docs) if classes is None else classes
    if classes <= ONE_SKETCH:
        return docs
    keys = docs.select(doc_key().alias("doc_key"), text_key().alias("text_key"), "text")

    def own(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray], list[int] | None]]:
        for _, _, i, hashes, first in _words(column):
            sets = shingle_hashes(hashes, first)
            yield i, [np.unique(h[h % np.uint64(classes) == k]) for h in sets], [len(np.unique(h)) for h in sets] if k == 0 else None

    def counted(k: int) -> DataFrame:
        def of_class(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for _, sets, _ in own(batch.column(0), k):
                yield np.concatenate([np.zeros(0, np.uint64), *sets])

        bits, _ = repeated_cells(docs.select("text"), of_class)
        shared = docs.sparkSession.sparkContext.broadcast(bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, sets, sizes in own(batch.column(2), k):
                    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                    alone = np.concatenate([[0], np.cumsum(~reached(np.concatenate([np.zeros(0, np.uint64), *sets]), shared.value))])
                    n = len(sets)
                    columns = [np.full(n, k), np.diff(alone[at]), np.zeros(n, np.int64) if sizes is None else np.array(sizes)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), *(pa.array(c, pa.int32()) for c in columns)], names=["doc_key", "text_key", "class", "alone", "size"])

        out, _ = written(keys.mapInArrow(released(run), "doc_key long, text_key long, class int, alone int, size int"), "alone")
        shared.destroy()
        return out

    parts = counted(0)
    for k in range(1, -int(-CLASS_SHARE * classes // 1)):
        parts = parts.unionAll(counted(k))
    # rows that repeat id and text say the same
    by_class = parts.groupBy("doc_key", "text_key", "class").agg(F.max("alone").alias("alone"), F.max("size").alias("size"))
    kept = by_class.groupBy("doc_key", "text_key").agg(F.sum("alone").alias("alone"), F.sum("size").alias("size")).where(F.col("alone") <= F.col("size") - F.ceil(F.col("size") * threshold - _SLACK))
    keyed = docs.select("doc_id", "text", doc_key().alias("doc_key"), text_key().alias("text_key"))
    out, _ = written(keyed.join(kept.select("doc_key", "text_key"), ["doc_key", "text_key"], "left_semi").select("doc_id", "text"), "candidates")
    return out


def _shingles(docs: DataFrame, nodes: DataFrame, sketch: Broadcast | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """nodes(node, doc_key, text_key) -> (node, shingles): the distinct hashes of all shingles, ascending. With a sketch, of those texts alone that can have a similar one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, cuts, i, hashes, first in _words(batch.column(2)):
                sets = [np.unique(h.view(np.int64)) for h in shingle_hashes(hashes, first)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                flat = np.concatenate([np.zeros(0, np.int64), *sets])
                if sketch is not None:
                    alone = np.concatenate([[0], np.cumsum(~reached(flat.view(np.uint64), sketch.value[0]))])
                    size = np.diff(at)
                    kept = (size == 0) | (np.diff(alone[at]) <= size - np.ceil(size * threshold - _SLACK))
                else:
                    kept = np.ones(len(sets), bool)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                whole = pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), batch.column(1).slice(i, len(sets)), lists], names=["doc_key", "text_key", "shingles"])
                yield whole.filter(pa.array(kept))

    rows = docs.select(doc_key().alias("doc_key"), text_key().alias("text_key"), "text").mapInArrow(released(run), "doc_key long, text_key long, shingles array<long>")
    # by id and text, so copies of a text don't meet in a task
    return rows.dropDuplicates(["doc_key", "text_key"]).join(nodes.select("node", "doc_key", "text_key").hint("shuffle_merge"), ["doc_key", "text_key"]).select("node", "shingles")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs(u, v) whose shingles have at least this Jaccard similarity."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    shared = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("n"), (F.size("a") + F.size("b")).alias("m"))
    return shared.where((F.col("m") == 0) | (F.col("n") >= threshold * (F.col("m") - F.col("n")) - _SLACK)).select("u", "v")


def bucket_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For members of a bucket in order: pairs (later, earlier) with the first and the closest earlier member within the radius."""
    later, earlier = [], []
    for i in range(0, len(fps), COMPARE):
        mine = fps[i : i + COMPARE]
        first = np.full(len(mine), -1)
        best = np.full(len(mine), radius + 1)
        where = np.full(len(mine), -1)
        for j in range(0, i + len(mine), COMPARE):
            distance = np.bitwise_count(mine[:, None] ^ fps[None, j : j + COMPARE]).astype(np.int64)
            before = (j + np.arange(distance.shape[1]))[None, :] < (i + np.arange(len(mine)))[:, None]
            distance = np.where(before, distance, radius + 1)
            near = distance.min(axis=1)
            at = distance.argmin(axis=1)
            hit = near <= radius
            first = np.where((first < 0) & hit, j + (distance <= radius).argmax(axis=1), first)
            where, best = np.where(near < best, j + at, where), np.minimum(near, best)
        for x in (first, where):
            found = np.flatnonzero(x >= 0)
            later.append(i + found)
            earlier.append(x[found])
    return np.concatenate(later), np.concatenate(earlier)


def ordered_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of neighbours in order of fingerprint that are within the radius."""
    order = np.argsort(fps, kind="stable")
    near = np.bitwise_count(fps[order[1:]] ^ fps[order[:-1]]) <= radius
    a, b = order[1:][near], order[:-1][near]
    return np.maximum(a, b), np.minimum(a, b)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of rows sorted by the first one, cut between its values."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        held.append(tuple(c.to_numpy() for c in batch.columns))
        columns = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        if not len(columns[0]):
            continue
        # the last bucket may go on in the next batch
        end = int(np.searchsorted(columns[0], columns[0][-1]))
        if end:
            yield tuple(x[:end] for x in columns)
        held = [tuple(x[end:] for x in columns)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _cuts(bucket: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))


def _candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes(node, fps) -> distinct links (u, v) of nodes within the radius."""
    signed = np.array(covering_masks(radius), np.uint64).view(np.int64)
    masks = F.posexplode(F.array(*[F.lit(int(m)) for m in signed])).alias("t", "mask")
    rows = nodes.select("node", F.posexplode("fps").alias("k", "fp")).select("node", "k", "fp", masks).select(F.xxhash64("k", "t", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "node", "fp")

    def links(bucket: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = _cuts(bucket)
        size = np.diff(cut)
        # most shared buckets hold two
        a = cut[:-1][size == 2]
        a = a[np.bitwise_count(fp[a].view(np.uint64) ^ fp[a + 1].view(np.uint64)) <= radius]
        u, v = [node[a + 1]], [node[a]]
        for a, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            some, fps = node[a : a + n], fp[a : a + n].view(np.uint64)
            x, y = (bucket_links if n <= COMPARE else ordered_links)(fps, radius)
            once = np.unique(x, return_index=True)[1]  # the first that each is near to: that holds a group together, and rows are no more than texts
            u.append(some[x[once]])
            v.append(some[y[once]])
        both = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, c])) for c in (0, 1)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_buckets(batches):
            yield links(*columns)

    return rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(released(run), "u long, v long").distinct()


def apart_within(component: np.ndarray, sizes: np.ndarray, places: np.ndarray, parities: np.ndarray, threshold: float, closest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For members of a bucket in order of component: pairs of different components that may be similar; with `closest`, of each text
    and other component only the pair whose parities differ least, among COMPARE texts of the other side.

    places: of the bucket's shingle in each one's order; parities: [member, word]. If the
    shingle is the first that a pair shares, no more can be shared than remain from there; two sets' parities differ in
    no more bits than the sets have shingles that are not shared."""
    share = threshold / (1 + threshold)
    for i in range(0, len(sizes), COMPARE):
        mine = slice(i, i + COMPARE)
        for j in range(int(np.searchsorted(component, component[i], side="right")), len(sizes), COMPARE):
            other = slice(j, j + COMPARE)
            a, b = sizes[mine, None], sizes[None, other]
            left = np.minimum(a - places[mine, None], b - places[None, other])
            x, y = np.nonzero((left >= share * (a + b) - _SLACK) & (component[mine, None] < component[None, other]))
            if not len(x):
                continue
            u, v = i + x, j + y
            apart = np.bitwise_count(parities[u] ^ parities[v]).sum(axis=1, dtype=np.int64)
            near = apart <= (1 - 2 * share) * (sizes[u] + sizes[v]) + _SLACK
            u, v, apart = u[near], v[near], apart[near]
            if closest and len(u):
                order = np.lexsort((apart, u, component[v]))
                u, v = u[order], v[order]
                first = np.concatenate([[True], (component[v[1:]] != component[v[:-1]]) | (u[1:] != u[:-1])])
                u, v = u[first], v[first]
            if len(u):
                yield u, v


def rare_prefixes(shingles: np.ndarray, at: np.ndarray, level: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the set, place, shingle): of each set in order of level and hash the first of which similar sets share one, but those of level 0, which only one set has. at: each set's first shingle, and the end."""
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((shingles, level, owner))
    place = np.arange(len(shingles)) - at[owner]
    # the owners are in order already
    long = place <= (size - np.ceil(size * threshold - _SLACK))[owner]
    kept = np.flatnonzero(long & (level[order] > 0))
    return owner[kept], place[kept], shingles[order[kept]]


def parity_bits(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[set, word]: of so many cells that a set's shingles fall into, whether their number is odd."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    cell = (mix(shingles.view(np.uint64)) % np.uint64(64 * PARITIES)).astype(np.int64)
    odd = np.bincount(64 * PARITIES * owner + cell, minlength=64 * PARITIES * n) & 1
    return np.packbits(odd.reshape(n, -1).astype(bool), axis=1, bitorder="little").view(np.uint64).reshape(n, PARITIES)


def _prefixes(texts: DataFrame, sketch: Broadcast, threshold: float, wanted: Broadcast | None = None) -> DataFrame:
    """texts(node, shingles, component) -> (bucket, component) of each shingle of a prefix; with `wanted`, of those buckets alone, and all that apart_within() needs."""
    names = ["bucket", "component", *(["node", "n", "place", *(f"parity{k}" for k in range(PARITIES))] if wanted is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(i, _TEXTS)
                shingles = batch.column(1).flatten().to_numpy()
                at = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
                twice = reached(shingles.view(np.uint64), sketch.value[0])
                level = twice.astype(np.int8) + (twice & reached(shingles.view(np.uint64), sketch.value[1]))
                owner, place, bucket = rare_prefixes(shingles, at, level, threshold)
                # sets without any share their lack
                none = np.flatnonzero(np.diff(at) == 0)
                owner, place, bucket = (np.concatenate(x) for x in ((owner, none), (place, np.zeros(len(none), np.int64)), (bucket, np.zeros(len(none), np.int64))))
                columns = [bucket, batch.column(2).to_numpy()[owner]]
                if wanted is not None:
                    kept = reached_narrow(bucket.view(np.uint64), wanted.value)
                    owner = owner[kept]
                    columns = [c[kept] for c in columns] + [batch.column(0).to_numpy()[owner], np.diff(at)[owner], place[kept], *parity_bits(shingles, at)[owner].view(np.int64).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in columns], names=names)

    return texts.select("node", "shingles", "component").mapInArrow(released(run), ", ".join(f"{c} long" for c in names))


def _prefix_pairs(texts: DataFrame, sketch: Broadcast, threshold: float, closest: bool) -> DataFrame:
    """texts(node, shingles, component) -> distinct (u, v) of different components, stored: all that can be similar, or, with `closest`, the likeliest."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).to_numpy().view(np.uint64)

    # a bucket of one component has nothing to compare, and most are
    several, _ = repeated_cells(_prefixes(texts, sketch, threshold).distinct().select("bucket"), keys, width_bits=BUCKET_BITS)
    shared = texts.sparkSession.sparkContext.broadcast(several)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, component, node, n, place, *columns in _whole_buckets(batches):
            cut = _cuts(bucket)
            parities = np.stack(columns, axis=1).view(np.uint64)
            u, v, total = [], [], 0
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if component[a] == component[b - 1]:
                    continue
                for x, y in apart_within(component[a:b], n[a:b], place[a:b], parities[a:b], threshold, closest):
                    u.append(node[a:b][x])
                    v.append(node[a:b][y])
                    total += len(x)
                    if total > _PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (u, v)], names=["u", "v"])
                        u, v, total = [], [], 0
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (u, v)], names=["u", "v"])

    rows = _prefixes(texts, sketch, threshold, shared)
    pairs, _ = written(rows.repartition("bucket").sortWithinPartitions("bucket", "component").mapInArrow(released(run), "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
    shared.destroy()
    return pairs


def groups(docs: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, text_key, group_id and group_key.

    group_id is the least doc_id among the near duplicates that it is linked with, group_key the least text_key() of that id there."""
    some = candidates_of(docs.select("doc_id", "text"), threshold)
    sketch = docs.sparkSession.sparkContext.broadcast(shared_shingles(some))
    profiles, _ = written(_profiles(docs), "profiles")
    both = ["text_hash", "text_hash2"]
    # the least document: an id goes before none, and of an id's texts the one of the least key
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    copies = profiles.groupBy(*both).agg(first, F.min("fps").alias("fps"))
    # one number for each distinct text, given as the table is written: ids can be null or repeat
    nodes, _ = written(copies.select(F.monotonically_increasing_id().alias("node"), *both, "first", "fps"), "nodes")
    keyed = nodes.select("node", F.xxhash64("first.doc_id", "first.text_key").alias("doc_key"), "first.text_key")
    sets, _ = written(_shingles(some, keyed, sketch, threshold), "shingles")
    near, _ = written(_candidates(nodes.join(sets.select("node"), "node").select("node", "fps"), radius), "candidates")
    links, _ = written(_similar(near, sets, threshold), "links")
    for closest in (True, False):
        comps, _ = written(connected_components(links), "components")
        texts = sets.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        pairs = _prefix_pairs(texts, sketch, threshold, closest)
        more = comps.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v")
        links, _ = written(more.unionAll(_similar(pairs, sets, threshold)), "links")
    sketch.destroy()
    comps, _ = written(connected_components(links), "components")
    labelled = nodes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("first").alias("least"))
    by_text, _ = written(labelled.join(least, "component").select(*both, F.col("least.doc_id").alias("group_id"), F.col("least.text_key").alias("group_key")), "groups")
    return profiles.select("doc_id", "text_key", *both).join(by_text, both).select("doc_id", "text_key", "group_id", "group_key")
