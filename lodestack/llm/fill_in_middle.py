"""Fill-in-middle: documents cut between tokens into prefix, middle and suffix, and put in another order.

A block of texts has one bitvector with a bit for each byte, set on the last byte of
each token, packed into 64-bit words; a directory holds the number of set bits before
each BLOCK_WORDS words. Rank at the ends of a text gives its number of tokens n, and
select on two ranks gives the bytes at which it is cut, so no list of tokens exists.

A token is white space and the word behind it, or the white space that ends a text
(`[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`). The cuts and the form come
from the sha256 of a seed and the document's id alone: reruns, other partitions and
other machines agree.

Defined results: null texts are empty; an empty text, or one that holds a marker, is
plain; a null id hashes as an empty one; rows that share an id are cut by the same
four numbers, and equal rows give equal rows; texts of any length are handled whole;
an empty table gives an empty table; other columns pass through, whatever their names
and types, but for those that the result itself adds, which it replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestack.llm.textblock import WHITE, as_bytes, blocks, map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of a hundred documents, those that stay plain; of a hundred others, those that begin with the suffix.
PLAIN_PERCENT, SPM_PERCENT = 50, 80
#: 64-bit words that an entry of the directory covers.
BLOCK_WORDS = 8

ADDED = StructType([
    StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()),
    StructField("middle_chars", LongType()), StructField("output", StringType()),
])


class BitVector:
    """Rank and select over packed bits."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros(-(-(self.size + 1) // (64 * BLOCK_WORDS)) * 64 * BLOCK_WORDS, bool)
        padded[: self.size] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.counts = np.bitwise_count(self.words).astype(np.int64)
        blocks_of = self.counts.reshape(-1, BLOCK_WORDS)
        self.directory = np.concatenate([[0], np.cumsum(blocks_of.sum(axis=1))])
        self.within = np.cumsum(blocks_of, axis=1) - blocks_of

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place of 0 .. size."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block = word // BLOCK_WORDS
        below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.directory[block] + self.within[block, word % BLOCK_WORDS] + below

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the set bit before which k others are set, 0 <= k < total."""
        block = np.searchsorted(self.directory, k, side="right") - 1
        left = k - self.directory[block]
        word = (self.within[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.within[block, word]
        bits = np.unpackbits(self.words[block * BLOCK_WORDS + word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return 64 * (block * BLOCK_WORDS + word) + (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)


def token_ends(data: np.ndarray, offsets: np.ndarray) -> BitVector:
    """Bits at the last byte of each token of the texts that offsets cut data into."""
    white = WHITE[data]
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:]] = True  # place k + 1 is the start of a text: byte k ends one
    last = last[1:]
    after = np.concatenate([white[1:], [True]]) if len(data) else white
    return BitVector(last | (~white & after))


def document_numbers(doc_id: object, seed: int = SEED) -> list[int]:
    """The first four 8-digit groups of the hex sha256 of seed, colon and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def _chars(raw: bytes) -> int:
    """Code points: bytes that don't continue one."""
    return int((np.frombuffer(raw, np.int8) >= -64).sum())


def _rows(ids: list, data: np.ndarray, offsets: np.ndarray, seed: int, markers: tuple[bytes, bytes, bytes]) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text of a block."""
    ends = token_ends(data, offsets)
    ranks = ends.rank(offsets)
    n = np.diff(ranks)
    h = np.array([document_numbers(i, seed) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    # a cut behind k tokens is behind the k-th of the text's set bits
    places = np.where(cuts > 0, 0, offsets[:-1, None])
    inside = np.nonzero(cuts)
    places[inside] = ends.select((ranks[:-1, None] + cuts - 1)[inside]) + 1
    p, s, m = markers
    out = []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = data[a:b].tobytes()
        if not text or any(x in text for x in markers) or h[i, 2] % 100 >= PLAIN_PERCENT:
            out.append((int(n[i]), "plain", None, None, text))
            continue
        x, y = (int(v) - a for v in places[i])
        prefix, middle, suffix = text[:x], text[x:y], text[y:]
        form = "spm" if h[i, 3] % 100 < SPM_PERCENT else "psm"
        parts = (s, suffix, p, prefix) if form == "spm" else (p, prefix, s, suffix)
        out.append((int(n[i]), form, _chars(prefix), _chars(middle), b"".join((*parts, m, middle))))
    return out


def fill_in_middle(docs: DataFrame, seed: int = SEED, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """docs plus n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output."""
    docs = docs.drop(*ADDED.names)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    raw, docs_names = tuple(m.encode() for m in markers), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(text_at))
            for i, j in blocks(offsets):
                rows = _rows(batch.column(id_at).slice(i, j - i).to_pylist(), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], seed, raw)
                n, form, prefix, middle, output = zip(*rows, strict=True)
                new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in output], pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), *new], names=[*docs_names, *ADDED.names])

    return map_batches(docs, run, [*docs.schema.fields, *ADDED.fields])


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text again, from an output and its form. Its own markers are the first ones: texts that hold any are plain."""
    p, s, m = markers
    first, second = F.when(form == "spm", F.lit(p)).otherwise(F.lit(s)), F.lit(m)
    body = F.substr(output, F.length(F.when(form == "spm", F.lit(s)).otherwise(F.lit(p))) + 1)
    cut, end = F.position(first, body), F.position(second, body)
    head, tail = F.substr(body, F.lit(1), cut - 1), F.substr(body, cut + F.length(first), end - cut - F.length(first))
    middle = F.substr(body, end + F.length(second))
    moved = F.when(form == "spm", F.concat(tail, middle, head)).otherwise(F.concat(head, middle, tail))
    return F.when(form == "plain", output).otherwise(moved)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Contract digest of fill_in_middle() over whole documents."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), u AS (
  SELECT doc_id, x, w, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t
), c AS (
  SELECT doc_id, x, n, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(w[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(w[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(w[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM u
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN x ELSE p || m || s END) AS restored_sha256
FROM c
"""
