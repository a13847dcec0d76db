"""Whole-text token ids from a public tokenizer file, with a bounded memo of pieces.

A text is cut where the tokenizer's own rules make the two sides independent: at
a blank or line feed between characters that are plain (ASCII, or Latin letters of
U+00C0 to U+00FF), and, in runs of plain characters, where letters, digits and
marks change. Each distinct piece goes to the tokenizers library once and is found
in a table after that. Whatever is not plain (other scripts, other white space,
apostrophes, the text of an added token) stays in one piece with what is around it,
up to the next such cut, and the library's whole chain encodes that piece; where
there is no cut that is the whole text. A tokenizer whose rules are not one of the
two known chains encodes whole texts.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lodestack.llm.textblock import as_bytes, blocks

# a worker is one of many on its machine: the library's own threads would only contend
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept by a worker (about 60 bytes each). Beyond that the half that came last goes: frequent pieces come early.
MEMO_PIECES = 1_000_000
#: Longer pieces are encoded each time.
LONGEST = 24

# The split rule of the word-level file, and the characters that stand for bytes in byte-level vocabularies.
_WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARACTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_ODD, _LETTER, _DIGIT, _MARK, _BLANK, _LINE, _APOSTROPHE = range(7)
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[32, 10, 39]] = _BLANK, _LINE, _APOSTROPHE
_VISIBLE = np.array([False, True, True, True, False, False, True])
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_KEEP_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _classes(data: np.ndarray, specials: list[bytes]) -> np.ndarray:
    """Class of every byte; both bytes of a Latin letter are letters, those of an added token's text are odd."""
    out = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    follow = data[lead + 1]
    lead = lead[(follow >= 0x80) & (follow != 0x97) & (follow != 0xB7)]
    out[lead] = out[lead + 1] = _LETTER
    raw = data.tobytes() if specials else b""
    for s in specials:
        at = raw.find(s)
        while at >= 0:
            out[at : at + len(s)] = _ODD
            at = raw.find(s, at + 1)
    return out


class _PieceTable:
    """Open-addressed table of pieces of up to LONGEST bytes. A key is a row of all bytes and the length, so a hit is exact."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.n, self.used = 0, 0
        self.keys = np.zeros((1024, 4), np.uint64)
        self.offset = np.zeros(1024, np.int32)
        self.count = np.zeros(1024, np.uint8)
        self.pool = np.zeros(4096, np.int32)
        self._slots(1 << 12)

    def _slots(self, n: int) -> None:
        self.slots = np.full(n, -1, np.int32)
        self._place(np.arange(self.n), _hash(self.keys[: self.n]))

    def _place(self, entries: np.ndarray, h: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            lost = self.slots[at] != entries
            entries, at = entries[lost], (at[lost] + 1) & mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each piece, or -1."""
        mask = len(self.slots) - 1
        at = _hash(keys) & mask
        out = self.slots[at]
        stored = self.keys.take(out, axis=0)  # an empty slot's -1 takes some row, too
        wrong = stored[:, 0] != keys[:, 0]
        for k in range(1, 4):
            wrong |= stored[:, k] != keys[:, k]
        todo = np.flatnonzero(wrong & (out >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & mask
            entry = self.slots[at]
            out[todo] = entry
            other = (entry >= 0) & (self.keys[entry] != keys[todo]).any(axis=1)
            todo, at = todo[other], at[other]
        return out

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """New, distinct pieces."""
        if self.n + len(keys) > self.capacity:
            self.n = min(self.n, self.capacity // 2)
            self.used = int(self.offset[self.n - 1]) + int(self.count[self.n - 1]) if self.n else 0
            self._slots(len(self.slots))
        count, flat = _flat(ids)
        self._room(len(keys), len(flat))
        new = slice(self.n, self.n + len(keys))
        self.keys[new], self.count[new] = keys, count
        self.offset[new] = self.used + np.cumsum(count) - count
        self.pool[self.used : self.used + len(flat)] = flat
        self.n, self.used = new.stop, self.used + len(flat)
        if 2 * self.n > len(self.slots):
            self._slots(1 << (2 * self.n).bit_length())
        else:
            self._place(np.arange(new.start, new.stop), _hash(keys))

    def _room(self, entries: int, ids: int) -> None:
        """Space for so many more entries, and ids in the pool."""
        grown = lambda a, n: a if n <= len(a) else np.concatenate([a, np.zeros((max(n - len(a), len(a)), *a.shape[1:]), a.dtype)])
        self.keys, self.offset, self.count = (grown(a, self.n + entries) for a in (self.keys, self.offset, self.count))
        self.pool = grown(self.pool, self.used + ids)

    def borrow(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets in the pool, and counts, of ids that only the next gathering sees."""
        count, flat = _flat(ids)
        self._room(0, len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        return self.used + np.cumsum(count) - count, count


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    return count, np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))


def _hash(keys: np.ndarray) -> np.ndarray:
    h = keys[:, 0] * _K[0] ^ keys[:, 1] * _K[1] ^ keys[:, 2] * _K[2] ^ keys[:, 3] * _K[3]
    h ^= h >> np.uint64(32)
    h *= _K[0]
    return (h >> np.uint64(24)).astype(np.int64)


class PieceMemo:
    """Ids of texts. byte_level: a blank belongs to the piece after it; else white space is dropped and case folded."""

    def __init__(self, file: str, memo_pieces: int = MEMO_PIECES):
        self.tokenizer = Tokenizer.from_file(file)
        rules = json.loads(self.tokenizer.to_str())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = [t.content.encode() for t in added]
        plain_added = not any(t.lstrip or t.rstrip or t.single_word or t.normalized or t.content.split() != [t.content] for t in added)
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        words = [{"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}, byte_level | {"use_regex": False}]
        folds = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        split = rules["pre_tokenizer"] or {}
        steps = [{k: v for k, v in s.items() if k != "trim_offsets"} for s in split.get("pretokenizers", [split])]
        normal = (rules["normalizer"] or {}).get("normalizers", rules["normalizer"])
        self.byte_level = steps == [byte_level] and normal is None
        self.cuts = plain_added and rules["model"]["type"] == "BPE" and not rules["model"]["dropout"] and (self.byte_level or (steps == words and normal == folds))
        self.table = _PieceTable(memo_pieces)
        self.model = self.tokenizer.model
        if self.cuts:
            self.model._resize_cache(0)  # no piece is asked for twice

    def _whole(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)] if texts else []

    def _plain(self, pieces: list[bytes]) -> list[list[int]]:
        """Pieces that the chain's split leaves whole: the model alone is asked."""
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(p.decode("latin-1").translate(_BYTE_CHARACTERS))] for p in pieces]

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (each with end_id behind it, if given) and n + 1 offsets; null counts as empty."""
        data, offsets = as_bytes(column)
        ids, sizes = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
        for i, j in blocks(offsets):
            raw, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            flat, bounds = self._block(raw, cut) if self.cuts else self._texts(raw, cut)
            if end_id is not None:
                flat = np.insert(flat, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
            ids.append(flat.astype(self.dtype))
            sizes.append(np.diff(bounds))
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self._whole([data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        return np.array([i for x in ids for i in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, and which of them are plain."""
        n = len(data)
        c = _classes(data, self.specials)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        white = np.flatnonzero((c == _BLANK) | (c == _LINE))
        before = first[white] | _VISIBLE[c[white - 1]]
        after = first[white + 1] | _VISIBLE[c[np.minimum(white + 1, n - 1)]]
        good = before & after
        bad = (c == _ODD) | (c == _APOSTROPHE)
        bad[white[~good]] = True
        chunk = first  # where a piece starts whatever is around it
        cut = white[good]
        chunk[cut] = True
        chunk[cut[c[cut] == _LINE] + 1] = True
        # within plain characters, also where the class changes; a blank stays with what follows
        change = (c[1:] != c[:-1]) & (c[:-1] != _BLANK)
        if not self.byte_level:
            change |= (c[1:] == _DIGIT) & (c[:-1] == _DIGIT)
        starts = np.flatnonzero(chunk[:-1] | np.concatenate([[True], change]))
        is_chunk = chunk[starts]
        of = np.cumsum(is_chunk) - 1
        heads = starts[is_chunk]
        odd = np.add.reduceat(bad, heads, dtype=np.int64) > 0
        starts, of = starts[is_chunk | ~odd[of]], of[is_chunk | ~odd[of]]
        plain = ~odd[of]
        ends = np.append(starts[1:], n)
        if not self.byte_level:  # white space at the edges has no ids
            starts = starts + (plain & ((c[starts] == _BLANK) | (c[starts] == _LINE)))
        return starts, ends, plain

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        starts, ends, plain = self._pieces(data, offsets)
        size = ends - starts
        padded = np.zeros(len(data) + LONGEST + 8, np.uint8)
        padded[: len(data)] = data
        if not self.byte_level:  # the model sees plain pieces in lower case
            upper = ((data >= 65) & (data <= 90)).astype(np.uint8)
            latin = np.flatnonzero(data[:-1] == 0xC3) + 1
            upper[latin] = (data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)
            odd = np.flatnonzero(~plain)
            upper[np.repeat(starts[odd] - np.cumsum(size[odd]) + size[odd], size[odd]) + np.arange(size[odd].sum())] = 0
            padded[: len(data)] += upper * np.uint8(32)
        eights = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
        short = np.flatnonzero(size <= LONGEST)
        at, n = (starts, size) if len(short) == len(starts) else (starts[short], size[short])
        keys = np.empty((len(at), 4), np.uint64)
        for k in range(3):  # bytes 0-7, 8-15 and 16-23, zero beyond the piece
            keys[:, k] = eights[at + 8 * k] & _KEEP_LOW[np.clip(n - 8 * k, 0, 8)]
        keys[:, 3] = n
        raw = padded.tobytes()

        def encoded(which: np.ndarray) -> list[list[int]]:
            pieces = [raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
            out: list[list[int]] = [[]] * len(pieces)
            for some, encode in ((True, self._plain), (False, self._whole)):
                chosen = [i for i in np.flatnonzero(plain[which] == some).tolist() if pieces[i]]
                for i, ids in zip(chosen, encode([pieces[i] for i in chosen]), strict=True):
                    out[i] = ids
            return out

        found = self.table.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort(keys[new].T)]
            differs = np.concatenate([[True], (keys[order[1:]] != keys[order[:-1]]).any(axis=1)])
            one = np.sort(order[differs])  # in order of arrival
            stays = self.table.n + len(one) <= self.table.capacity
            self.table.add(keys[one], encoded(short[one]))
            if stays:
                found[new] = self.table.find(keys[new])
            else:  # entries that were found above can be gone
                found = self.table.find(keys)
                if (found < 0).any():
                    return self._texts(data, offsets)
        entry = np.zeros(len(starts), np.int64)
        entry[short] = found
        offset, count = self.table.offset[entry].astype(np.int64), self.table.count[entry].astype(np.int64)
        long = np.flatnonzero(size > LONGEST)
        if len(long):
            offset[long], count[long] = self.table.borrow(encoded(long))
        edge = np.concatenate([[0], np.cumsum(count)])
        flat = self.table.pool[np.repeat(offset - edge[:-1], count) + np.arange(edge[-1])]
        # a piece starts at every text's start, except at those of empty texts
        return flat, edge[np.searchsorted(ends, offsets, side="right")]


def tokenizer_file(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def memo_for(file: str) -> PieceMemo:
    """One memo for each worker process and vocabulary."""
    return PieceMemo(file)
