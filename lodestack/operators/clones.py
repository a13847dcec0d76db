"""Clones: stretches of code that are equal but for names, literals, comments and layout.

Sources become streams of token codes in which all names are one code, and so are numbers and
strings. Of the hashes of all LEAST tokens in a row the least of each WINDOW is a fingerprint,
so that any two equal stretches of LEAST + WINDOW - 1 tokens share one, and fingerprints are few. All
places of a fingerprint are seeds with its first place, not with each other. Seeds of two files that
lie on one diagonal are chained, and a chain is extended token by token in both directions,
so that each pair is exact and as long as can be.

What is found: of each stretch of LEAST + WINDOW - 1 tokens or more that also stands earlier (by
repository, path and place), all but the WINDOW - 1 tokens at either end lie in pairs with
earlier ones, of LEAST tokens or more each; the ends do, too, where the same first place shares them. Of pairs
whose later stretch lies in another's, the other stays. Pairs of later places with each other
follow from those and are not listed.

Defined results: null and empty contents have no tokens; sources of any length are whole;
rows of one repository and path are files of their own; a stretch that overlaps its own copy ends where the copy
begins; null repositories and paths come first; an empty table gives empty tables; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from lodestack.operators.goparse import ROWS, TOKEN
from lodestack.shared import stored

#: Tokens of the shortest clone, and hashes of which one is kept at least.
LEAST = 50
WINDOW = 8
#: A fingerprint is hot if it has more than one of so many places; there are fewer hot ones than this.
HOT_SHARE = 1024
SALTS = 64
#: Tokens whose windows are looked at together.
_CHUNK = 1 << 15
#: Letters of tokens that are kept while a task runs, and how many are.
_SHORT, _KNOWN = 32, 1 << 16
_BREAK = re.compile("\n")
#: Tasks that the pairs of one earlier file are dealt to at most, and pairs that a task takes, about.
SHARES = 256
PAIRS_A_TASK = 4096

# Keywords of Go, and its operators of more than one character.
KEYWORDS = (
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
).split()
OPERATORS = "&& || <- ... := ++ -- == != <= >= += -= *= /= %= &= |= ^= << >> &^ <<= >>= &^=".split()

_NAME, _NUMBER, _STRING, _FIRST = 1, 2, 3, 256
_CODES = {t: _FIRST + i for i, t in enumerate([*KEYWORDS, *OPERATORS])}
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1 << 10)], np.uint64)


def _token(kind: str, t: str) -> tuple[int, int]:
    """A token's code, and a hash of it as it stands."""
    if kind == "word":
        code = _CODES.get(t, _NAME)
    else:
        code = _NUMBER if kind == "number" else _STRING if kind == "string" else _CODES.get(t) or 4 + ord(t[0]) % 251
    return code, int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def tokens(text: str, known: dict[str, tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its code, a hash of it as it stands, its first and its last line. known: short tokens that were seen, as sources share most."""
    known = {} if known is None else known
    found, spans = [], []
    for m in TOKEN.finditer(text):
        t = m.group()
        of_t = known.get(t)  # no two kinds of token are written the same
        if of_t is None:
            if m.lastgroup == "comment":
                continue
            of_t = _token(m.lastgroup, t)
            if len(t) <= _SHORT and len(known) < _KNOWN:
                known[t] = of_t
        found.append(of_t)
        spans.append(m.span())
    codes, exact = np.array(found, np.int64).reshape(-1, 2).T
    breaks = np.array([m.start() for m in _BREAK.finditer(text)], np.int64)
    lines = np.searchsorted(breaks, np.array(spans, np.int64).reshape(-1, 2)).astype(np.int32) + np.int32(1)
    return codes.astype(np.int16), np.ascontiguousarray(exact), np.ascontiguousarray(lines[:, 0]), np.ascontiguousarray(lines[:, 1])


def fingerprints(codes: np.ndarray, least: int = LEAST, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place): of the hashes of `least` tokens in a row, the last least one of each `window`."""
    if len(codes) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, places = [], []
    values = codes.astype(np.uint64) + np.uint64(1)
    for i in range(0, len(codes) - least + 1, _CHUNK):
        part = np.lib.stride_tricks.sliding_window_view(values[i : i + _CHUNK + least - 1], least)
        h = (part * _POWERS[:least]).sum(axis=1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes.append(h ^ (h >> np.uint64(29)))
    h = np.concatenate(hashes)
    width = min(window, len(h))
    for i in range(0, len(h) - width + 1, _CHUNK):
        part = np.lib.stride_tricks.sliding_window_view(h[i : i + _CHUNK + width - 1], width)
        places.append(np.unique(i + np.arange(len(part)) + width - 1 - part[:, ::-1].argmin(axis=1)))
    at = np.unique(np.concatenate(places))
    return h[at].view(np.int64), at


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning, compared in pieces that grow, so that the cost follows it."""
    n, at, size = min(len(a), len(b)), 0, 64
    while at < n:
        differs = np.flatnonzero(a[at : min(at + size, n)] != b[at : min(at + size, n)])
        if len(differs):
            return at + int(differs[0])
        at, size = at + size, 2 * size
    return n


def common_run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """Tokens before and from places i and j that are equal."""
    return _equal(a[:i][::-1], b[:j][::-1]), _equal(a[i:], b[j:])


STREAM = StructType().add("codes", "binary").add("exact", "binary").add("first", "binary").add("last", "binary")


def streams(files: DataFrame) -> DataFrame:
    """files(repo_id, path, content) -> (file, repo_id, path, codes, exact, first, last), stored; `file` numbers them in order of repository and path."""
    schema = StructType([files.schema["repo_id"], files.schema["path"], *STREAM.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                arrays = zip(*(tokens(t or "", known) for t in batch.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x.tobytes() for x in column], pa.binary()) for column in arrays)], names=schema.names)

    # stored first: a sort by ranges reads its rows twice
    rows = stored(files.select("repo_id", "path", "content").mapInArrow(run, schema), "tokens")
    return stored(rows.repartitionByRange("repo_id", "path").sortWithinPartitions("repo_id", "path", "exact").withColumn("file", F.monotonically_increasing_id()), "streams")


def seeds(found: DataFrame, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """streams -> (file_a, at_a, file_b, at_b): each place of a fingerprint with the first one."""

    def places_of(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["hash", "file", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, amount = [], 0
            for file, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, at = fingerprints(np.frombuffer(codes.as_buffer(), np.int16), least, window)
                held.append((h, np.full(len(h), file, np.int64), at))
                amount += len(h)
                if amount > _CHUNK:
                    yield places_of(held)
                    held, amount = [], 0
            if held:
                yield places_of(held)

    places = stored(found.select("file", "codes").mapInArrow(run, "hash long, file long, at long"), "fingerprints")
    firsts = stored(places.groupBy("hash").agg(F.min(F.struct("file", "at")).alias("a"), F.count("*").alias("n")).where("n > 1"), "firsts")
    # a fingerprint of more than a thousandth of all places is dealt to SALTS groups; of those there are fewer than HOT_SHARE
    limit = max(places.count() // HOT_SHARE, 1)
    hot = F.broadcast(firsts.where(F.col("n") > limit).select("hash", F.lit(True).alias("hot")))
    left = places.join(hot, "hash", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("file", F.lit(SALTS))).otherwise(0))
    right = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > limit, SALTS - 1).otherwise(0)).cast("array<bigint>")))
    out = left.join(right, ["hash", "salt"]).where("file <> a.file or at <> a.at")
    return out.select(F.col("a.file").alias("file_a"), F.col("a.at").alias("at_a"), F.col("file").alias("file_b"), F.col("at").alias("at_b"))


def chains(rows: DataFrame, reach: int = LEAST) -> DataFrame:
    """seeds -> (file_a, file_b, starts): the first seed of each chain, which goes on along a diagonal while the next seed is within reach."""
    along = Window.partitionBy("file_a", "file_b", "diagonal").orderBy("at_b")
    first = F.col("at_b") - F.lag("at_b").over(along) > reach
    heads = rows.withColumn("diagonal", F.col("at_b") - F.col("at_a")).withColumn("head", F.coalesce(first, F.lit(True))).where("head")
    return heads.groupBy("file_a", "file_b").agg(F.collect_list(F.struct("at_a", "at_b")).alias("starts"))  # no more than a file has tokens


SPAN = StructType([StructField(c, LongType()) for c in ("at_a", "at_b", "start_a", "end_a", "start_b", "end_b", "tokens", "same")] + [StructField("consistent", BooleanType())])


def _spans(a: dict[str, np.ndarray], b: dict[str, np.ndarray], starts: list[tuple[int, int]], one_file: bool, least: int) -> list[dict]:
    out, reached = {}, 0
    for i, j in starts:  # in order of j
        if j + least <= reached:
            continue  # lies in a span that is found: sources that repeat themselves have many such places
        before, behind = common_run(a["codes"], b["codes"], i, j)
        i, j, n = i - before, j - before, before + behind
        if one_file:
            n = min(n, j - i)
        if n < least or (i, j) in out:
            continue
        reached = max(reached, j + n)
        x, y = a["exact"][i : i + n], b["exact"][j : j + n]
        names = a["codes"][i : i + n] == _NAME
        mine, other = x[names].tolist(), y[names].tolist()
        one_to_one = len(set(zip(mine, other, strict=True))) == len(set(mine)) == len(set(other))
        out[i, j] = {
            "at_a": i, "at_b": j, "start_a": int(a["first"][i]), "end_a": int(a["last"][i + n - 1]), "start_b": int(b["first"][j]), "end_b": int(b["last"][j + n - 1]),
            "tokens": n, "same": int((x == y).sum()), "consistent": bool(one_to_one),
        }
    return list(out.values())


def clone_pairs(files: DataFrame, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """files(repo_id, path, content) -> (repo_a, path_a, start_a, end_a, repo_b, path_b, start_b, end_b, tokens, similarity, consistent).

    Lines are inclusive. similarity: share of tokens that are the same as they stand. consistent: names correspond one to one."""
    found = streams(files)
    share = F.pmod("file_b", F.lit(SHARES)).cast("int").alias("share")
    pairs = stored(chains(seeds(found, least, window), least).select("file_a", share, "file_b", "starts"), "pairs")
    # the stream of an earlier file goes to each share of its later ones once, before them; pairs are small, so bytes do not say how much work they are
    firsts = stored(pairs.select("file_a", "share").distinct(), "earlier")
    no = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    a = firsts.join(found, F.col("file") == F.col("file_a")).select("file_a", "share", no(pairs, "file_b").alias("file_b"), "repo_id", "path", *STREAM.names, no(pairs, "starts").alias("starts"))
    b = pairs.join(found, F.col("file") == F.col("file_b")).select("file_a", "share", "file_b", "repo_id", "path", *STREAM.names, "starts")
    n_tasks = -(-max(pairs.count(), 1) // PAIRS_A_TASK)
    both = a.unionAll(b).repartition(n_tasks, "file_a", "share").sortWithinPartitions("file_a", "share", "file_b")  # nulls are first
    kinds = {"codes": np.int16, "exact": np.int64, "first": np.int32, "last": np.int32}
    names = ["repo_a", "path_a", "repo_b", "path_b", "file_a", "file_b"]
    place = [files.schema["repo_id"].dataType, files.schema["path"].dataType]
    schema = StructType([StructField(c, t) for c, t in zip(names, [*place, *place, LongType(), LongType()], strict=True)] + [StructField("spans", ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([(f.name, pa.bool_() if f.name == "consistent" else pa.int64()) for f in SPAN]))
        earlier: dict = {}  # a task holds the tokens of an earlier file, and a later one's at a time
        for batch in batches:
            column = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            out: list[tuple] = []
            files_a, files_b = column["file_a"].to_pylist(), column["file_b"].to_pylist()
            repos, paths = column["repo_id"].to_pylist(), column["path"].to_pylist()
            for i, (file_a, file_b) in enumerate(zip(files_a, files_b, strict=True)):
                stream = {k: np.frombuffer(column[k][i].as_buffer(), t) for k, t in kinds.items()}
                if file_b is None:
                    earlier = {"repo": repos[i], "path": paths[i], "stream": {k: v.copy() for k, v in stream.items()}}
                    continue
                starts = sorted(((s["at_a"], s["at_b"]) for s in column["starts"][i].as_py()), key=lambda s: (s[1], s[0]))
                spans = _spans(earlier["stream"], stream, starts, file_a == file_b, least)
                out.append((earlier["repo"], earlier["path"], repos[i], paths[i], file_a, file_b, spans))
            types = [column["repo_id"].type, column["path"].type] * 2 + [pa.int64(), pa.int64(), span]
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], t) for k, t in enumerate(types)], names=schema.names)

    spans = both.mapInArrow(run, schema).select(*names, F.explode("spans").alias("s")).withColumn("end", F.col("s.at_b") + F.col("s.tokens"))
    before = Window.partitionBy("file_b").orderBy("s.at_b", F.desc("end"), "file_a", "s.at_a").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.max("end").over(before)).where("reached is null or reached < end")
    return spans.select("repo_a", "path_a", "s.start_a", "s.end_a", "repo_b", "path_b", "s.start_b", "s.end_b", "s.tokens", (F.col("s.same") / F.col("s.tokens")).alias("similarity"), "s.consistent")


def clone_classes(pairs: DataFrame) -> DataFrame:
    """(repo_id, path, start_line, end_line, tokens, n_places, n_files, least_similarity): stretches that others are clones of."""
    # places in the stretch's own file, itself included, and the files besides; the pairs are made once
    of = ["repo_a", "path_a", "start_a", "end_a"]
    by_file = pairs.groupBy(*of, "repo_b", "path_b").agg(F.max("tokens").alias("tokens"), F.count("*").alias("n"), F.min("similarity").alias("similarity"))
    elsewhere = ~(F.col("repo_b").eqNullSafe(F.col("repo_a")) & F.col("path_b").eqNullSafe(F.col("path_a")))
    out = by_file.groupBy(*of).agg(F.max("tokens").alias("tokens"), (F.sum("n") + 1).alias("n_places"), (F.count_if(elsewhere) + 1).alias("n_files"), F.min("similarity").alias("least_similarity"))
    return out.withColumnsRenamed({"repo_a": "repo_id", "path_a": "path", "start_a": "start_line", "end_a": "end_line"})


def duplication_issues(pairs: DataFrame) -> DataFrame:
    """An issue for each later place of a pair."""
    where = F.concat(F.col("path_a"), F.lit(":"), F.col("start_a").cast("string"), F.lit("-"), F.col("end_a").cast("string"))
    return pairs.select(
        F.col("repo_b").alias("repo_id"), F.col("path_b").alias("file_path"), F.lit("duplication").alias("type"), F.lit("warning").alias("severity"), F.col("start_b").cast("int").alias("line"),
        F.concat(F.lit("Lines "), F.col("start_b").cast("string"), F.lit("-"), F.col("end_b").cast("string"), F.lit(" repeat "), where).alias("message"),
        F.lit("Consider sharing one implementation").alias("suggestion"),
    )
