"""Suffixes of a text in order, bucket by bucket, with a difference cover for long ties (numpy).

The cover modulo MOD is a set such that any two positions have a shift below MOD
that takes both into it. Suffixes at cover positions are ranked first, by prefix
doubling. Then one bucket of suffixes at a time (those that share their first
eight bytes stay together) is sorted by its first 32 bytes, and what still ties
is settled by one look at the cover ranks after the shift, in a three-way
quicksort over all ties of the bucket at once. Memory follows the bucket.
"""

from __future__ import annotations

import numpy as np

MOD = 31
COVER = (1, 5, 11, 24, 25, 27)
HEAD = 32
#: Suffixes of a bucket, unless more than that share eight bytes.
BUCKET = 1 << 18

_IN = np.zeros(MOD, bool)
_IN[list(COVER)] = True
_SHIFT = np.array([[next(d for d in range(MOD) if _IN[(i + d) % MOD] and _IN[(j + d) % MOD]) for j in range(MOD)] for i in range(MOD)])


def big_endian_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number that orders like them; zeros follow the text."""
    w = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        w = (w[:-width] << np.uint64(8 * width)) | w[width:]
    return w


def _dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Rank by their first `depth` bytes or more of the suffixes at cover positions below n + MOD (elsewhere 0)."""
    sample = np.flatnonzero(_IN[np.arange(n + MOD) % MOD])
    keys = [words[sample + k] for k in range(0, HEAD, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    new[:1] = 1
    ranks = np.zeros(n + MOD + 1, np.int64)
    ranks[sample] = _dense(order, new)
    have, step = HEAD, MOD
    while have < depth:
        key = ranks[sample] * (len(sample) + 2) + ranks[np.minimum(sample + step, n + MOD)]
        order = np.argsort(key)
        k = key[order]
        ranks[sample] = _dense(order, np.concatenate([[1], (k[1:] != k[:-1]).astype(np.int64)]))
        have, step = step + have, 2 * step
    return ranks


def _settle(order: np.ndarray, run: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Sort each run of tied suffixes (positions in `order`, ids in `run`, ascending) by cover ranks."""
    at = np.arange(len(order))
    while len(at):
        first = np.concatenate([[True], run[1:] != run[:-1]])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(run)))
        keep = np.repeat(size > 1, size)
        at, run = at[keep], run[keep]
        if not len(at):
            break
        start, size = np.concatenate([[0], np.cumsum(size[size > 1])[:-1]]), size[size > 1]
        here = order[at]
        pivot = np.repeat(here[start + size // 2], size)
        shift = _SHIFT[here % MOD, pivot % MOD]
        side = np.sign(ranks[here + shift] - ranks[pivot + shift])
        key = run * 3 + side + 1
        by = np.argsort(key, kind="stable")
        order[at] = here[by]
        key = key[by]
        # those equal to the pivot are settled
        unsettled = side[by] != 0
        at, run = at[unsettled], np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))[unsettled]
    return order


def equal_prefix_classes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Class number of each start, the same for starts whose `length` bytes are equal (length >= 40)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(2 * MOD + HEAD + length, np.uint8)])
    words = big_endian_words(padded)
    ranks = cover_ranks(words, n, length)
    out = np.empty(len(starts), np.int64)
    head = words[starts]
    by_head = np.argsort(head, kind="stable")
    heads = head[by_head]
    made, i = 0, 0
    while i < len(starts):
        j = min(i + BUCKET, len(starts))
        if j < len(starts):
            j = max(int(np.searchsorted(heads, heads[j])), int(np.searchsorted(heads, heads[i], side="right")))
        members = by_head[i:j]
        pos = starts[members]
        keys = [words[pos + k] for k in range(0, HEAD, 8)]
        order = np.lexsort(keys[::-1])
        tied = np.ones(len(order), bool)
        for k in keys:
            tied[1:] &= k[order][1:] == k[order][:-1]
        tied[0] = False
        run = np.cumsum(~tied)
        place = np.empty(n, np.int64)
        ordered = _settle(pos[order], run, ranks)
        # neighbours in suffix order: same class if the rest of their prefix is equal, too
        same = tied.copy()
        for k in [*range(HEAD, length - 8, 8), length - 8]:
            w = words[ordered + k]
            same[1:] &= w[1:] == w[:-1]
        place[ordered] = made + np.cumsum(~same)
        out[members] = place[pos]
        made = int(place[ordered[-1]]) + 1
        i = j
    return out
