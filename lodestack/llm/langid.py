"""Language identification of mixed text.

Per-word scores are sums of character n-gram log-probabilities, learned for each
language from text alone. The script of a word narrows the languages that it can
be of, and Viterbi with a switching penalty over the words labels spans. Most
texts need no path search: if no language gains more than half the penalty over
the best one on any stretch, the constant path is optimal, as running sums show.

Defined results: a text that is null, empty or has no letter is `und` with score 0
and no spans, and so are all texts where nothing could be learned, as from an empty
table; very long texts are scored whole, in blocks of their own; rows without a lang
teach nothing; all values of lang are learned, whatever their number;
a null doc_id counts as not held out; repeated rows are scored and taught like any
others; ties between languages go to the first in alphabetical order; other columns
pass through, whatever their names, but those named like the results are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lodestack.llm.textblock import map_batches, released

#: Documents of a language that it is learned from, on average; they are picked by a hash of their id.
SAMPLE_DOCS = 2000
#: Languages of a group, whose tables take 0.75 MB each: no task and no broadcast holds more at a time, however many are learned.
LANGUAGES = 200
BUCKET_BITS = 16
ORDERS = (2, 3, 4)
PENALTY = 15.0
#: Least share of a language's letters that a script needs for its words to be of that language.
SCRIPT_SHARE = 0.001
#: Log-probabilities held at once: characters times languages.
BLOCK_SCORES = 1 << 20
UNDETERMINED = "und"

# First code points of blocks, by script (Unicode).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
_N_SCRIPTS = len(SCRIPTS) + 1


class _Characters:
    """Letter and script by code point."""

    def __init__(self):
        top = sys.maxunicode + 1
        self.letter = np.frombuffer(bytes(chr(i).isalpha() for i in range(top)), np.bool_)
        self.script = np.zeros(top, np.uint8)
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                self.script[a : b + 1] = k


_CHARACTERS: list[_Characters] = []


def _characters() -> _Characters:
    if not _CHARACTERS:
        _CHARACTERS.append(_Characters())
    return _CHARACTERS[0]


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Words:
    """Letter runs of some texts, and the n-grams that belong to each."""

    def __init__(self, texts: list[str]):
        chars = _characters()
        lowered = [t.lower() for t in texts]
        self.bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
        code = np.frombuffer(("\n" + "\n".join(lowered) + "\n\n\n\n\n").encode("utf-32-le", "surrogatepass"), "<u4")
        letter = chars.letter[code]
        self.starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        self.script = chars.script[code[self.starts]]
        self.first = np.searchsorted(self.starts, self.bounds + 1)
        self.code = np.where(letter, code, 32).astype(np.uint64)
        self.gaps = np.concatenate([[0], np.cumsum(~letter)])

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: bucket by position, and whether the gram has no gap inside."""
        m = len(self.code) - max(ORDERS)
        for n in ORDERS:
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + self.code[k : k + m]
                h ^= h >> np.uint64(29)
            inside = self.gaps[n - 1 : n - 1 + m] == self.gaps[1 : 1 + m]
            yield ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), inside


def _texts(column: pa.Array, limit: int) -> Iterator[tuple[int, list[str]]]:
    """Row of the first text, and texts of about `limit` characters together; null as empty."""
    held, size, first = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        held.append(t or "")
        size += len(t or "")
        if size >= limit:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def log_tables(counts: np.ndarray) -> list[np.ndarray]:
    """counts[language, order, bucket] -> for each order log-probabilities [bucket, language]."""
    c = counts.astype(np.float64) + 0.5
    log = np.log(c / c.sum(axis=2, keepdims=True)) / len(ORDERS)
    return [np.ascontiguousarray(log[:, k, :].T.astype(np.float32)) for k in range(len(ORDERS))]


def barred_scripts(scripts: np.ndarray) -> np.ndarray:
    """scripts[language, script] letters -> what a word of a script is charged in each language: nothing, or too much to be of it."""
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    allowed = share >= SCRIPT_SHARE
    allowed[:, ~allowed.any(axis=0)] = True
    return np.where(allowed.T, 0.0, -1e6)


def word_scores(words: Words, tables: list[np.ndarray]) -> np.ndarray:
    """[word, language] of some languages, before scripts count."""
    n = tables[0].shape[1]
    total = np.zeros((len(words.code) - max(ORDERS), n), np.float32)
    for (bucket, inside), table in zip(words.grams(), tables, strict=True):
        total += np.where(inside[:, None], table[bucket], 0)
    if not len(words.starts):
        return np.zeros((0, n))
    edges = np.stack([words.starts - 1, words.ends], axis=1).ravel()
    return np.add.reduceat(total.astype(np.float64), np.minimum(edges, len(total) - 1), axis=0)[::2]


class Model:
    """Languages in order, what scripts bar, and the tables of groups of languages, each a broadcast of its own."""

    def __init__(self, languages: list[str], scripts: np.ndarray, groups: list[Broadcast]):
        self.languages, self.barred, self.groups = languages, barred_scripts(scripts), groups

    def scores(self, words: Words) -> np.ndarray:
        """[word, language]"""
        parts = []
        for g in self.groups:
            parts.append(word_scores(words, g.value))
            if len(self.groups) > 1:  # one group's tables in memory at a time
                g.__dict__.pop("_value", None)
        return np.concatenate(parts, axis=1) + self.barred[words.script]


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language of each word on the best path, on which a change costs `penalty`."""
    n, k = scores.shape
    totals = scores.sum(axis=0)
    best = int(totals.argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, k)), gain[:-1]]), axis=0)
    # m stretches in other languages cost m - 1 changes at least; each gains at most what is tested here
    if (gain - low).max() <= penalty / 2:
        return np.full(n, best)
    ahead = [0.0] * k
    switched, tops = [], []
    for row in scores.tolist():
        top = max(range(k), key=ahead.__getitem__)
        floor = ahead[top] - penalty
        mask = 0
        for i in range(k):
            if ahead[i] < floor:
                ahead[i] = floor
                mask |= 1 << i
            ahead[i] += row[i]
        switched.append(mask)
        tops.append(top)
    path = np.empty(n, np.int64)
    at = max(range(k), key=ahead.__getitem__)
    for t in range(n - 1, -1, -1):
        path[t] = at
        if switched[t] >> at & 1:
            at = tops[t]
    return path


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, group: int = LANGUAGES) -> Model | None:
    """Model from docs(doc_id, text, lang) outside the held-out fold: all languages, a group of them at a time."""
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    scripts, groups = [], []
    for i in range(0, len(languages), group):
        some = languages[i : i + group]
        counts, letters = _counted(train, {x: min(1.0, sample_docs / sizes[x]) for x in some})
        groups.append(docs.sparkSession.sparkContext.broadcast(log_tables(counts)))
        scripts.append(letters)
    return Model(languages, np.concatenate(scripts), groups)


def _counted(train: DataFrame, shares: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams [language, order, bucket] and letters [language, script] of a share of the documents of some languages."""
    at = {x: i for i, x in enumerate(shares)}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    picked = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30) < F.try_element_at(share, F.col("lang"))
    sample = train.where(picked).select("text", "lang").repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        scripts: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, texts in _texts(batch.column(0), 1 << 20):
                for lang in set(langs[first : first + len(texts)]):
                    w = Words([t for t, x in zip(texts, langs[first:], strict=False) if x == lang])
                    c = grams.setdefault(at[lang], np.zeros((len(ORDERS), 1 << BUCKET_BITS), np.int64))
                    for k, (bucket, inside) in enumerate(w.grams()):
                        letters = inside & ((w.code[: len(inside)] != 32) | (w.code[1 : len(inside) + 1] != 32))
                        c[k] += np.bincount(bucket[letters], minlength=1 << BUCKET_BITS)
                    scripts.setdefault(at[lang], np.zeros(_N_SCRIPTS, np.int64))
                    scripts[at[lang]] += np.bincount(w.script, weights=w.ends - w.starts, minlength=_N_SCRIPTS).astype(np.int64)
        for k, c in grams.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c.astype(np.uint32).tobytes()], pa.binary()), pa.array([scripts[k].tobytes()], pa.binary())], names=["lang", "grams", "scripts"])

    counts = np.zeros((len(shares), len(ORDERS), 1 << BUCKET_BITS), np.int64)
    scripts = np.zeros((len(shares), _N_SCRIPTS), np.int64)
    for r in sample.mapInArrow(released(count), "lang int, grams binary, scripts binary").toLocalIterator():  # 8 rows a language
        counts[r["lang"]] += np.frombuffer(r["grams"], np.uint32).reshape(len(ORDERS), -1)
        scripts[r["lang"]] += np.frombuffer(r["scripts"], np.int64)
    return counts, scripts


def identify(docs: DataFrame, model: Model | None, penalty: float = PENALTY, with_spans: bool = True) -> DataFrame:
    """docs plus lang_pred, score (share of letters in spans of that language) and lang_spans (in words; null unless with_spans)."""
    added = StructType().add("lang_pred", "string").add("score", "double").add("lang_spans", ArrayType(StructType().add("start", "long").add("end", "long").add("lang", "string")))
    docs = docs.drop(*added.names)
    text_at, names = docs.columns.index("text"), docs.columns
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        for batch in batches:
            n = batch.num_rows
            pred, score, spans = [UNDETERMINED] * n, np.zeros(n), [[] for _ in range(n)]
            for first, texts in _texts(batch.column(text_at), BLOCK_SCORES // len(m.languages)) if m else ():
                words = Words(texts)
                table, sizes = m.scores(words), words.ends - words.starts
                for i in range(len(texts)):
                    a, b = words.first[i], words.first[i + 1]
                    if a == b:
                        continue
                    path = viterbi(table[a:b], penalty)
                    letters = np.bincount(path, weights=sizes[a:b], minlength=len(m.languages))
                    best = int(letters.argmax())
                    pred[first + i], score[first + i] = m.languages[best], letters[best] / letters.sum()
                    if with_spans:
                        cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [b - a]])
                        spans[first + i] = [{"start": int(x), "end": int(y), "lang": m.languages[path[x]]} for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            new = [pa.array(pred, pa.string()), pa.array(score), pa.array(spans, span_type) if with_spans else pa.nulls(n, span_type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *added.names])

    return map_batches(docs, run, [*docs.schema.fields, *added.fields])


def op7_viterbi_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract digest: learn outside the held-out fold, identify whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), learn(docs), with_spans=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
