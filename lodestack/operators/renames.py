"""Renamed files of a change: deleted and added ones whose lines are mostly the same.

The score of a deleted and an added file is the bytes of the lines that both have, repeats counted, by
the bytes of the larger one. Files of equal content are matched first, by a join of hashes. The
others are packed once in blocks of about a size, which hold a line of many files once; all pairs of blocks of a commit
whose sizes can reach the least score meet in Cartesian products of a share of the commits each, which read them where they are stored.
A line that few files of two blocks have adds to their pairs one by one, others as products of matrices. Matching goes in rounds: a pair
that is the best for both its files is a rename, and the rest goes on without them.

Defined results: null contents count as empty; empty files match nothing; of equal scores the least paths, new before old, come
first; rows that repeat commit and path count once, with the greatest content; all work is by commit, so nothing matches
across commits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack import shared
from lodestack.shared import stored

LEAST = 0.5
#: Files of a block at most, their lines together, about, and bytes of contents from which blocks are packed at once, about.
BLOCK = 1 << 10
BLOCK_LINES = 1 << 18
SLICE_BYTES = 16 << 20
#: Contents of a share of the commits, about, and shares at most.
SHARE_BYTES = 32 << 20
SHARES = 32
#: Matrix columns at once, and pairs of files that meet one by one at once, about.
_COLUMNS = 1 << 11
_CROSS = 1 << 18
#: Partitions in which blocks are packed, at least and at most.
_PARTS = 16, 4096
#: Seconds, about: a multiplication in a matrix, a pair that meets alone, a pair of a line's own table, such a table.
_TIMES = 7e-11, 2e-8, 3e-9, 2e-5
#: Pairs that pass in their order without rounds before.
FEW = 1 << 22


def _files(rows: DataFrame) -> DataFrame:
    """(commit, path, content): one of each place, and none that is empty."""
    return rows.groupBy("commit", "path").agg(F.max("content").alias("content")).where("content <> ''")


def _exact(old: DataFrame, new: DataFrame) -> DataFrame:
    """(commit, old_path, new_path) of equal contents: the first with the first, and so on."""
    place = lambda df, name: df.select("commit", F.col("path").alias(name), F.sha2("content", 256).alias("hash")).withColumn("k", F.row_number().over(Window.partitionBy("commit", "hash").orderBy(name)))
    return place(old, "old_path").join(place(new, "new_path"), ["commit", "hash", "k"]).select("commit", "old_path", "new_path")


def _sizes(rows: DataFrame) -> DataFrame:
    """(commit, bytes), stored: of the contents of each commit."""
    return shared.stored(rows.groupBy("commit").agg(F.sum(F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")).alias("bytes")), "sizes")


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them all."""
    return x.astype(np.min_scalar_type(int(x.max())))


def _packed(commit: str, path: pa.Array, size: np.ndarray, lines: pa.ListArray, amounts: pa.ListArray) -> Iterator[tuple]:
    """Blocks, by size: commit, paths, the files' sizes, the least and the greatest; lines in order, each with its bytes and the number of its files; these files, and how often they have the line."""
    count, line, amount = lines.value_lengths().to_numpy(), lines.flatten().to_numpy().view(np.uint64), amounts.flatten().to_numpy()
    start, order = np.cumsum(count) - count, np.argsort(size, kind="stable")
    cuts, total = [0], 0
    for k, n in enumerate(count[order].tolist()):
        if k - cuts[-1] == BLOCK or (total + n > BLOCK_LINES and k > cuts[-1]):
            cuts.append(k)
            total = 0
        total += n
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
        some = order[lo:hi]
        n = count[some]
        at = _ranges(start[some], n)
        at = at[by := np.argsort(line[at], kind="stable")]  # files stay in order
        owner, mine = np.repeat(np.arange(hi - lo, dtype=np.uint16), n)[by], line[at]
        new = np.concatenate([[True], mine[1:] != mine[:-1]])
        entry = np.flatnonzero(new | np.concatenate([[True], owner[1:] != owner[:-1]]))
        first = np.flatnonzero(new[entry])
        arrays = (mine[entry[first]], _small(amount[at[entry[first]]]), np.diff(first, append=len(entry)).astype(np.uint16), owner[entry], _small(np.diff(entry, append=len(at))))
        yield commit, path.take(pa.array(some)).to_pylist(), size[some].astype(np.int64).tobytes(), int(size[some[0]]), int(size[some[-1]]), *(x.tobytes() for x in arrays)


_BLOCK = pa.schema([("commit", pa.string()), ("paths", pa.list_(pa.string())), ("sizes", pa.binary()), ("least", pa.int64()), ("most", pa.int64()), ("lines", pa.binary()), ("bytes", pa.binary()), ("files", pa.binary()), ("owners", pa.binary()), ("times", pa.binary())])


def _blocks(rows: DataFrame, sizes: DataFrame, total: int, shares: int) -> DataFrame:
    """Blocks of _packed, stored by share; a commit's files are dealt out over slices of about SLICE_BYTES, so that a task holds one slice."""
    slices = sizes.where(F.col("bytes") > SLICE_BYTES).select("commit", F.ceil(F.col("bytes") / SLICE_BYTES).alias("n"))
    dealt = rows.join(F.broadcast(slices), "commit", "left").withColumn("slice", F.pmod(F.xxhash64("path"), F.coalesce("n", F.lit(1))))
    dealt = dealt.repartition(min(_PARTS[1], max(_PARTS[0], total // SLICE_BYTES)), "commit", "slice")
    files = dealt.groupBy("commit", "slice", "path").agg(F.max("content").alias("content")).where("content <> ''")
    each = lambda f: F.transform(F.split("content", "\n"), f)
    hashed = files.select("commit", "slice", "path", (F.octet_length("content") + 1).cast("long").alias("size"), each(lambda x: F.xxhash64(x)).alias("lines"), each(lambda x: F.octet_length(x) + 1).alias("bytes"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        path, size, lines, amounts = (pa.concat_arrays(table[x].chunks) for x in ("path", "size", "lines", "bytes"))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*_packed(key[0].as_py(), path, size.to_numpy(), lines, amounts), strict=True), _BLOCK.types, strict=True)], schema=_BLOCK)

    out = hashed.groupBy("commit", "slice").applyInArrow(pack, "commit string, paths array<string>, sizes binary, least long, most long, lines binary, bytes binary, files binary, owners binary, times binary")
    return shared.stored(out.withColumn("share", F.pmod(F.xxhash64("commit"), F.lit(shares)).cast("int")), "blocks", "share")


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n of each."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Block:
    """A block's arrays, where they are; bytes and times in whole numbers of the width that their lengths tell."""

    def __init__(self, sizes, lines, amounts, files, owners, times):
        view = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
        least = lambda x, n: view(x, f"u{x.as_buffer().size // n}")
        self.sizes, self.lines, self.files, self.owners = view(sizes, np.int64), view(lines, np.uint64), view(files, np.uint16).astype(np.int64), view(owners, np.uint16)
        self.amounts, self.times = least(amounts, len(self.lines)), least(times, len(self.owners))
        self.start = np.cumsum(self.files) - self.files

    def matrix(self, line: np.ndarray, column: np.ndarray, levels: np.ndarray, width: int, kind: type) -> np.ndarray:
        """[file, column + k]: 1 if the file has the line more than k times, for k below the line's levels."""
        n = self.files[line]
        at = _ranges(self.start[line], n)
        owner, column, times = self.owners[at], np.repeat(column, n), np.minimum(self.times[at].astype(np.int64), np.repeat(levels, n))
        out = np.zeros((len(self.sizes), width), kind)
        out[np.repeat(owner, times), _ranges(column, times)] = 1
        return out


def shared_bytes(x: _Block, y: _Block) -> np.ndarray:
    """[file of x, file of y]: bytes of the lines that both have, repeats counted."""
    shape = nx, ny = len(x.sizes), len(y.sizes)
    j = np.minimum(np.searchsorted(y.lines, x.lines), len(y.lines) - 1)
    i = np.flatnonzero(y.lines[j] == x.lines)
    j = j[i]
    cross = x.files[i] * y.files[j]
    out = np.zeros(nx * ny)
    # the times of lines that many files have, at most, and what the three ways take
    levels = np.ones(len(i), np.int64)
    multiply, alone, table, tables = _TIMES
    many = np.flatnonzero(cross * alone > multiply * nx * ny)
    if len(many):
        most = [np.maximum.reduceat(b.times[_ranges(b.start[k[many]], b.files[k[many]])], np.cumsum(b.files[k[many]]) - b.files[k[many]]) for b, k in ((x, i), (y, j))]
        levels[many] = np.minimum(*most)
    costs = np.stack([cross * alone, levels * (multiply * nx * ny), cross * table + tables])
    way = np.argmin(costs, axis=0)

    few = np.flatnonzero(way == 0)
    ends = np.cumsum(cross[few])
    lo = 0
    while lo < len(few):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _CROSS, "right")))
        a, b = i[few[lo:hi]], j[few[lo:hi]]
        lo = hi
        # each entry of x meets all of y's for its line
        n, m = x.files[a], y.files[b]
        p = np.repeat(_ranges(x.start[a], n), each := np.repeat(m, n))
        q = _ranges(np.repeat(y.start[b], n), each)
        weight = np.minimum(x.times[p], y.times[q]).astype(np.float64) * np.repeat(x.amounts[a], n * m)
        out += np.bincount(x.owners[p].astype(np.int64) * ny + y.owners[q], weight, nx * ny)
    out = out.reshape(shape)

    kind = np.float32 if max(x.sizes.max(), y.sizes.max()) < 1 << 24 else np.float64  # whole numbers that it holds exactly
    dense = np.flatnonzero(way == 1)
    ends = np.cumsum(levels[dense])
    lo = 0
    while lo < len(dense):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + _COLUMNS, "right")))
        some = dense[lo:hi]
        width, column = int(ends[hi - 1] - before), ends[lo:hi] - levels[some] - before
        left, right = x.matrix(i[some], column, levels[some], width, kind), y.matrix(j[some], column, levels[some], width, kind)
        left *= np.repeat(x.amounts[i[some]], levels[some]).astype(kind)
        out += left @ right.T
        lo = hi

    for k in np.flatnonzero(way == 2):
        p, q = (slice(b.start[n], b.start[n] + b.files[n]) for b, n in ((x, i[k]), (y, j[k])))
        out[np.ix_(x.owners[p], y.owners[q])] += np.minimum.outer(x.times[p], y.times[q]) * float(x.amounts[i[k]])
    return out


def scores(deleted: DataFrame, added: DataFrame, least: float = LEAST) -> DataFrame:
    """deleted and added(commit, path, content) -> (commit, old_path, new_path, score) of all pairs of at least this score (above 0)."""
    sizes = [_sizes(x) for x in (deleted, added)]
    totals = [x.agg(F.sum("bytes")).first()[0] or 0 for x in sizes]
    shares = min(SHARES, 1 + sum(totals) // SHARE_BYTES)
    old, new = (_blocks(*x, shares) for x in zip((deleted, added), sizes, totals, strict=True))
    # a smaller file has no more to share than it is long
    can = F.expr(f"a.commit = b.commit AND a.most >= {float(least)!r}D * b.least AND b.most >= {float(least)!r}D * a.least")
    block = ("paths", "sizes", "lines", "bytes", "files", "owners", "times")
    columns = ["a.commit AS commit", *(f"{s}.{x} AS {s}_{x}" for s in "ab" for x in block)]
    pairs = None
    for k in range(shares):
        a, b = (x.where(F.col("share") == k).alias(name) for x, name in ((old, "a"), (new, "b")))
        some = a.hint("shuffle_replicate_nl").join(b, can).selectExpr(*columns)
        pairs = some if pairs is None else pairs.unionAll(some)
    schema = pa.schema([("commit", pa.string()), ("old_path", pa.string()), ("new_path", pa.string()), ("score", pa.float64())])

    def pairs_of(commit: pa.Scalar, *row: pa.Scalar) -> pa.RecordBatch:
        (p, *x), (q, *y) = row[: len(block)], row[len(block) :]
        x, y = _Block(*x), _Block(*y)
        score = shared_bytes(x, y) / np.maximum(x.sizes[:, None], y.sizes[None, :])
        i, j = np.nonzero(score >= least)
        return pa.RecordBatch.from_arrays([pa.array([commit.as_py()] * len(i), pa.string()), p.values.take(pa.array(i)), q.values.take(pa.array(j)), pa.array(score[i, j])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield pairs_of(*(x[k] for x in batch.columns))
            del batch  # or two are held while the next one comes
            pa.default_memory_pool().release_unused()

    return pairs.mapInArrow(run, "commit string, old_path string, new_path string, score double")


def _in_order(pairs: DataFrame) -> DataFrame:
    """Of pairs by commit, the best first, those whose files no pair before has. A commit's pairs stream by; of its renames the paths are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        commit, olds, news = None, set(), set()
        for batch in batches:
            chosen = []
            for k, (c, x, y) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if c != commit:
                    commit, olds, news = c, set(), set()
                if x not in olds and y not in news:
                    olds.add(x)
                    news.add(y)
                    chosen.append(k)
            yield batch.take(pa.array(chosen, pa.int64()))

    rows = pairs.select("commit", "old_path", "new_path", "score").repartition("commit").sortWithinPartitions("commit", F.desc("score"), "new_path", "old_path")
    return rows.mapInArrow(run, pairs.select("commit", "old_path", "new_path", "score").schema)


def matched(pairs: DataFrame, few: int = FEW) -> DataFrame:
    """pairs(commit, old_path, new_path, score) -> those that are renames: by score, the best first, each file in one at most."""
    found = None
    by_old = Window.partitionBy("commit", "old_path").orderBy(F.desc("score"), "new_path", "old_path")
    by_new = Window.partitionBy("commit", "new_path").orderBy(F.desc("score"), "old_path", "new_path")
    before, n = None, pairs.count()
    while n > few and (before is None or 2 * n <= before):
        # the best pair of all is the best for both its files, so each round has one at least
        best = pairs.withColumn("i", F.row_number().over(by_old)).withColumn("j", F.row_number().over(by_new)).where("i = 1 and j = 1").drop("i", "j")
        best = stored(best, "renames")
        found = best if found is None else found.unionByName(best)
        pairs = stored(pairs.join(best.select("commit", "old_path"), ["commit", "old_path"], "left_anti").join(best.select("commit", "new_path"), ["commit", "new_path"], "left_anti"), "scores")
        before, n = n, pairs.count()
    rest = _in_order(pairs)
    return rest if found is None else found.unionByName(rest)


def renames(deleted: DataFrame, added: DataFrame, least: float = LEAST) -> DataFrame:
    """(commit, old_path, new_path, score): each file in one pair at most."""
    old, new = stored(_files(deleted), "old"), stored(_files(added), "new")
    exact = stored(_exact(old, new), "exact")
    left = old.join(exact.withColumnRenamed("old_path", "path"), ["commit", "path"], "left_anti")
    right = new.join(exact.withColumnRenamed("new_path", "path"), ["commit", "path"], "left_anti")
    return exact.withColumn("score", F.lit(1.0)).unionByName(matched(stored(scores(left, right, least), "scores")))
