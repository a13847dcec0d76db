"""Removal of what repeats across documents: the frame of the byte- and the word-level operator.

A window is `length` items (bytes or words). Each window has one anchor, the
least of the hashes of the shorter pieces within it, and equal windows have equal
anchors; neighbouring windows mostly share one, so a run of windows with one
anchor travels as one segment. First pass: a count-min sketch of all anchors.
Second pass: segments whose anchor is estimated repeated are dealt by anchor and
compared exactly there.

No group of equal or alike segments meets in one task. Equal segments of a batch
send on their least place alone: all other places start later, so their spans are
known at once. A heavy anchor (estimated `heavy` times or more, as at the edges of a
passage in many documents, where the surroundings differ) is not dealt by anchor:
its segments are cut to portions of `portion` windows, which are dealt by the hash
of the items that all windows of a portion have in common, so that different
surroundings part. The spans to remove go back to their documents by doc_id and a
hash of the text.

A window is removed from a place if it also starts earlier. Rows that repeat a
doc_id count as one document; of rows that repeat id and text each gets the same
result. A null doc_id counts as smaller than all others; ids are integers. Texts
are cut in blocks of about a megabyte, a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.sketch import HEAVY, reached, repeated_cells
from lodestack.llm.storage import written
from lodestack.llm.textblock import as_bytes, binary_array, blocks, mix, released, sliding_min

#: Payload bytes that are compared at once, unless one anchor has more.
REDUCE_BYTES = 1 << 19
_POSITION_BITS = np.uint64(27)
_POSITIONS = 1 << 26
NULL_ID = -(1 << 63)
MEMBER = np.dtype([("doc", "<i8"), ("text", "<i8"), ("at", "<i8")])


@dataclass(frozen=True)
class Segments:
    """Runs of windows with one anchor: windows a .. b of the block, the anchor's hash and place."""

    a: np.ndarray
    b: np.ndarray
    anchor: np.ndarray
    place: np.ndarray


def segments(hashes: np.ndarray, length: int, piece: int, bounds: np.ndarray) -> Segments:
    """hashes[i]: of the piece of `piece` items from i; bounds: the documents' first items and the end."""
    n = int(bounds[-1])
    empty = np.zeros(0, np.int64)
    parts = []
    for c in range(0, max(n - length + 1, 0), _POSITIONS):
        h = hashes[c : c + _POSITIONS + length - piece]
        packed = (h >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(h), dtype=np.uint64)
        width = length - piece + 1
        least = ((sliding_min(packed, width) if len(packed) >= width else packed[:0]) & np.uint64((1 << 27) - 1)).astype(np.int64)
        i = np.arange(c, c + len(least))
        end = bounds[np.searchsorted(bounds, i, side="right")] if len(bounds) < 64 else np.repeat(bounds[1:], np.diff(bounds))[i]
        inside = i + length <= end
        differs = least[1:] != least[:-1]
        first = inside & np.concatenate([[True], differs | ~inside[:-1]])
        last = inside & np.concatenate([differs | ~inside[1:], [True]])
        a = np.flatnonzero(first)
        parts.append((a + c, np.flatnonzero(last) + c, h[least[a]], least[a] + c))
    return Segments(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else Segments(empty, empty, np.zeros(0, np.uint64), empty)


@dataclass(frozen=True)
class Level:
    """What differs between bytes and words.

    cut(data, offsets): segments, the documents' first items, a function that gives
    the payload (bytes, offsets) of chosen runs of windows, and one that hashes runs of items.
    judge(payloads, docs, starts): for each window of all payloads end to end
    whether it also starts earlier, and the windows of each payload.
    windows(sizes): the number of windows of payloads of so many bytes.
    """

    length: int
    portion: int
    cut: Callable
    judge: Callable
    windows: Callable
    #: whether an earlier place in the same document counts, too
    same_document: bool = True
    #: occurrences from which an anchor is heavy
    heavy: int = HEAVY


def _keyed(docs: DataFrame) -> DataFrame:
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be an integer")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("hash"), "text")


def portions(s: Segments, chosen: np.ndarray, level: Level, hashes: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last windows, and keys, of the portions of chosen segments: windows whose starts lie alike before the anchor."""
    step, a, b, p = level.portion, s.a[chosen], s.b[chosen], s.place[chosen]
    low, high = (p - b) // step, (p - a) // step
    n = high - low + 1
    which = np.repeat(np.arange(len(n)), n)
    i = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    a, b, p = a[which], b[which], p[which]
    last = p - i * step  # the last start of a portion; all its windows hold the items from there to the first window's end
    key = hashes(last, last - (step - 1) + level.length)
    return np.maximum(a, last - (step - 1)), np.minimum(b, last), mix(key + i.astype(np.uint64))


_ROW = "key long, payload binary, doc long, hash long, start long, end long"


def _rows(key: np.ndarray, payload: pa.Array, who: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(key.view(np.int64)), payload, *(pa.array(np.ascontiguousarray(who[f])) for f in MEMBER.names), pa.array(end)]
    return pa.RecordBatch.from_arrays(cols, names=["key", "payload", "doc", "hash", "start", "end"])


def _least(of: np.ndarray, who: np.ndarray, same_document: bool) -> np.ndarray:
    """Which members of classes `of` (numbered from 0, none empty) are their class's least: by document and, if places count, by place."""
    order = np.lexsort((who["at"], who["doc"], of))
    least = who[order[np.searchsorted(of[order], np.arange(int(of.max(initial=-1)) + 1))]][of]
    out = who["doc"] == least["doc"]
    return out & (who["at"] == least["at"]) if same_document else out


def _merged_rows(who: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans (who, its place as start, end) as disjoint ones for each document and text."""
    if not len(who):
        return who, end
    order = np.lexsort((who["at"], who["text"], who["doc"]))
    who, end = who[order], end[order]
    group = np.cumsum(np.concatenate([[False], (who["doc"][1:] != who["doc"][:-1]) | (who["text"][1:] != who["text"][:-1])]))
    shift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (who["at"] + shift)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return who[first], (reach - shift)[np.append(first[1:] - 1, len(who) - 1)]


def spans_to_remove(docs: DataFrame, level: Level) -> DataFrame:
    """docs(doc_id, text) -> (doc, hash, start, end): items that repeated windows cover; spans can overlap."""
    spark = docs.sparkSession
    keyed = _keyed(docs)

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, offsets = as_bytes(batch.column(0))
        for i, j in blocks(offsets):
            yield level.cut(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0].anchor

    sketch = spark.sparkContext.broadcast(repeated_cells(docs.select("text"), keys, level.heavy))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = as_bytes(batch.column(2))
            seen: dict[bytes, int] = {}
            keys, members, classes = [np.zeros(0, np.uint64)], [np.zeros(0, MEMBER)], [np.zeros(0, np.int64)]
            for i, j in blocks(offsets):
                s, firsts, payload, hashed = level.cut(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                twice = reached(s.anchor, sketch.value[0])
                heavy = twice & reached(s.anchor, sketch.value[1])
                a, b, key = s.a[twice & ~heavy], s.b[twice & ~heavy], s.anchor[twice & ~heavy]
                if heavy.any():
                    a, b, key = (np.concatenate(x) for x in zip((a, b, key), portions(s, np.flatnonzero(heavy), level, hashed), strict=True))
                if not len(a):
                    continue
                row = np.searchsorted(firsts, a, side="right") - 1
                who = np.empty(len(a), MEMBER)
                who["doc"], who["text"], who["at"] = names[i + row], hashes[i + row], a - firsts[row]
                blob, cuts = payload(a, b)
                blob, cuts = blob.tobytes(), cuts.tolist()
                classes.append(np.fromiter((seen.setdefault(blob[x:y], len(seen)) for x, y in zip(cuts, cuts[1:], strict=False)), np.int64, len(a)))
                keys.append(key)
                members.append(who)
            of, key, who = np.concatenate(classes), np.concatenate(keys), np.concatenate(members)
            pieces = list(seen)
            windows = level.windows(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            least = _least(of, who, level.same_document)
            on = np.flatnonzero(least)
            yield _rows(key[on], pa.array([pieces[k] for k in of[on].tolist()], pa.binary()), who[on], np.zeros(len(on), np.int64))
            # all windows of the other places start earlier, too
            gone, end = _merged_rows(who[~least], who["at"][~least] + windows[of[~least]] - 1 + level.length)
            yield _rows(mix(gone["text"].view(np.uint64)), pa.nulls(len(gone), pa.binary()), gone, end)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple]] = {}
        size, last = 0, None
        gone: list[tuple] = []
        for batch in batches:
            known = batch.filter(batch.column("payload").is_null())
            if known.num_rows:
                yield known.select(["doc", "hash", "start", "end"])
            rows = batch.filter(batch.column("payload").is_valid())
            for key, payload, doc, text, at in zip(*(rows.column(k).to_pylist() for k in range(5)), strict=True):
                if size >= REDUCE_BYTES and key != last:
                    yield _compared(held, level)
                    held, size = {}, 0
                last = key
                have = held.get(payload)
                if have is None:
                    held[payload] = [(doc, text, at)]
                    size += len(payload)
                    continue
                mine, theirs = ((doc, at), (have[0][0], have[0][2])) if level.same_document else (doc, have[0][0])
                if mine < theirs:
                    gone += [(payload, m) for m in have]
                    held[payload] = [(doc, text, at)]
                elif mine > theirs:
                    gone.append((payload, (doc, text, at)))
                elif (doc, text, at) not in have:
                    have.append((doc, text, at))
            if gone:
                yield _spans(np.array([m for _, m in gone], MEMBER), level.windows(np.array([len(p) for p, _ in gone])) - 1 + level.length)
                gone = []
        if held:
            yield _compared(held, level)

    found = keyed.mapInArrow(released(suspects), _ROW)
    # written, so that the sketch can go before the texts are joined
    out, _ = written(found.repartition("key").sortWithinPartitions("key").mapInArrow(released(compare), "doc long, hash long, start long, end long"), "spans")
    sketch.destroy()
    return out


def _spans(who: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (who["doc"], who["text"], who["at"], who["at"] + sizes)], names=["doc", "hash", "start", "end"])


def _compared(held: dict[bytes, list[tuple]], level: Level) -> pa.RecordBatch:
    """Spans to remove in the least places of some payloads: runs of windows that start earlier in others."""
    payloads = list(held)
    who = np.array([m for members in held.values() for m in members], MEMBER)
    of = np.repeat(np.arange(len(payloads)), [len(members) for members in held.values()])
    least = who[np.searchsorted(of, np.arange(len(payloads)))]
    earlier, windows = level.judge(payloads, least["doc"], least["at"])
    start = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(windows)), windows)
    a = np.flatnonzero(earlier & np.concatenate([[True], ~earlier[:-1] | (owner[1:] != owner[:-1])]))
    b = np.flatnonzero(earlier & np.concatenate([~earlier[1:] | (owner[1:] != owner[:-1]), [True]]))
    run_of, first, size = owner[a], a - start[owner[a]], b - a + level.length
    runs = np.bincount(run_of, minlength=len(windows))
    run_start = np.cumsum(runs) - runs
    count = runs[of]
    member = np.repeat(np.arange(len(who)), count)
    which = np.repeat(run_start[of], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    out = who[member]
    out["at"] += first[which]
    return _spans(out, size[which])


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans, ascending, that cover the same items."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs plus, as last column, an array of the document's (start, end); null where nothing repeats."""
    doc, text_hash, doc2, hash2, at = unused(docs.columns, "doc", "hash", "doc2", "hash2", "spans")
    by_doc = spans.groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "end")).alias(at)).select(F.col("doc").alias(doc2), F.col("hash").alias(hash2), at)
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), text_hash: F.xxhash64("text")})
    joined = keyed.join(by_doc, (F.col(doc) == F.col(doc2)) & (F.col(text_hash) == F.col(hash2)), "left")
    return joined.drop(doc, text_hash, doc2, hash2)


def spans_of(column: pa.Array, i: int) -> np.ndarray:
    """Merged spans of row i of an Arrow column as with_spans() gives it."""
    if not column[i].is_valid:
        return np.zeros((0, 2), np.int64)
    values = column[i].values
    return merged(np.stack([values.field(0).to_numpy(), values.field(1).to_numpy()], axis=1))


__all__ = ["Level", "Segments", "binary_array", "merged", "segments", "spans_of", "spans_to_remove", "with_spans"]
