"""Shortest line difference of two texts, and patches made from it and applied again.

Lines end at a line feed alone. Lines that one side lacks are taken out first, equal starts and ends
next; what remains is divided at the middle of a shortest edit (the greedy method from both
ends, in linear space), all diagonals of a step at once in numpy, till a part has CELLS pairs of lines at most, which a
table of bits settles, one integer a line. Time follows the length of the texts by the number of edits that the common lines need, memory the length alone.
Where numbers of lines are all that is asked, the table's last row tells them, and no other is kept.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

#: Unchanged lines around a change.
CONTEXT = 3
#: Pairs of lines, one bit each, of a part that is not divided further.
CELLS = 1 << 28
_NO_END = "\\ No newline at end of file\n"
_HEADER = re.compile(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_NEVER = -(1 << 40)
# Escapes of quoted paths.
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}


def lines(text: str) -> list[str]:
    """Lines with their line feeds; the last may lack it."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + parts[-1:] * bool(parts[-1])


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal elements at the start of both."""
    n, at, size = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : min(at + size, n)] != b[at : min(at + size, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, size = at + size, size * 2
    return n


def _step(v: np.ndarray, zero: int, d: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One more edit: v[zero + k], the furthest place in a on each diagonal k = x - y, for those of d's parity; returns these k."""
    low, high = max(-d, -len(b)), min(d, len(a))
    k = np.arange(low + (low + d) % 2, high + 1, 2)
    right, down = v[zero + k - 1] + 1, v[zero + k + 1]
    x = np.maximum(np.where(right > len(a), _NEVER, right), np.where(down - k > len(b), _NEVER, down))
    active = np.flatnonzero((x >= 0) & (x - k >= 0))
    while active.size > 4:
        at, to = x[active], x[active] - k[active]
        inside = (at < len(a)) & (to < len(b))
        active, at, to = active[inside], at[inside], to[inside]
        active = active[a[at] == b[to]]
        x[active] += 1
    for i in active:
        x[i] += _run(a[x[i] :], b[x[i] - k[i] :])
    v[zero + k] = x
    return k


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A place of a shortest edit with half of its edits on either side; needs two edits at least."""
    n, m = len(a), len(b)
    zero, delta = m + 1, n - m
    forward, backward = np.full(n + m + 3, _NEVER), np.full(n + m + 3, _NEVER)
    back_zero = m + 1
    forward[zero + 1] = backward[back_zero + 1] = 0
    back_a, back_b = a[::-1], b[::-1]
    d = 0
    while True:
        k = _step(forward, zero, d, a, b)
        if delta % 2:
            k = k[np.abs(k - delta) <= d - 1]
            met = np.flatnonzero(forward[zero + k] + backward[back_zero + delta - k] >= n)
            if met.size:
                x = int(forward[zero + k[met[0]]])
                return x, x - int(k[met[0]])
        k = _step(backward, back_zero, d, back_a, back_b)
        if delta % 2 == 0:
            k = k[np.abs(k - delta) <= d]
            met = np.flatnonzero(backward[back_zero + k] + forward[zero + delta - k] >= n)
            if met.size:
                x = int(backward[back_zero + k[met[0]]])
                return n - x, m - (x - int(k[met[0]]))
        d += 1


def _grown(a: list[int], b: list[int], rows: list[int] | None = None) -> int:
    """A bit a line of b where the longest common subsequence grows, after all lines of a; the same after each line of a goes to rows."""
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    everything = row = (1 << len(b)) - 1
    for x in a:
        grown = row & places.get(x, 0)
        row = (row + grown | row - grown) & everything
        if rows is not None:
            rows.append(row ^ everything)
    return row ^ everything


def _table(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places in a and in b of a longest common subsequence."""
    rows = [0]
    _grown(a, b, rows)
    i, j, left, right = len(a), len(b), [], []
    while found := (rows[i] & ((1 << j) - 1)).bit_length():  # the last line of b before j where the length grows
        j = found - 1
        while rows[i - 1] >> j & 1:
            i -= 1
        i -= 1
        left.append(i)
        right.append(j)
    return left, right


def _common(old: list[str], new: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Numbers and places of the lines that the other side has, too."""
    lines_of = dict.fromkeys(chain(old, new))
    number = dict(zip(lines_of, range(len(lines_of)), strict=True))
    a, b = (np.fromiter(map(number.__getitem__, side), np.int64, len(side)) for side in (old, new))
    there = np.zeros((2, len(number)), bool)
    there[0, a] = there[1, b] = True
    places = np.flatnonzero(there[1, a]), np.flatnonzero(there[0, b])
    return (a[places[0]], b[places[1]]), places


def _ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Numbers of equal lines at the start, and behind those at the end."""
    head = _run(a, b)
    return head, _run(a[head:][::-1], b[head:][::-1])


def n_kept(old: list[str], new: list[str]) -> int:
    """Number of lines that a shortest edit leaves."""
    (a, b), _ = _common(old, new)
    head, tail = _ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) * len(b) > CELLS:
        return int(kept(old, new)[0].sum())
    return head + tail + _grown(a.tolist(), b.tolist()).bit_count()


def kept(old: list[str], new: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the lines of old and of new that a shortest edit leaves: equal in number, equal in order."""
    keep = np.zeros(len(old), bool), np.zeros(len(new), bool)
    (a, b), places = _common(old, new)
    boxes = [(0, len(a), 0, len(b))]
    while boxes:
        a0, a1, b0, b1 = boxes.pop()
        head, tail = _ends(a[a0:a1], b[b0:b1])
        for mask, place, start, end in ((keep[0], places[0], a0, a1), (keep[1], places[1], b0, b1)):
            mask[place[start : start + head]] = True
            mask[place[end - tail : end]] = True
        a0, a1, b0, b1 = a0 + head, a1 - tail, b0 + head, b1 - tail
        if (a1 - a0) * (b1 - b0) <= CELLS:
            left, right = _table(a[a0:a1].tolist(), b[b0:b1].tolist())
            keep[0][places[0][np.array(left, np.int64) + a0]] = True
            keep[1][places[1][np.array(right, np.int64) + b0]] = True
        else:
            x, y = _middle(a[a0:a1], b[b0:b1])
            boxes += [(a0, a0 + x, b0, b0 + y), (a0 + x, a1, b0 + y, b1)]
    return keep


def _blocks(keep_old: np.ndarray, keep_new: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end in old, start, end in new) of each run of changed lines."""
    both = np.flatnonzero(keep_old), np.flatnonzero(keep_new)
    ends = [np.append(x, len(k)) for x, k in zip(both, (keep_old, keep_new), strict=True)]
    starts = [np.append(0, x + 1) for x in both]
    some = np.flatnonzero((ends[0] > starts[0]) | (ends[1] > starts[1]))
    return [(int(starts[0][i]), int(ends[0][i]), int(starts[1][i]), int(ends[1][i])) for i in some]


def _range(start: int, n: int) -> str:
    """A range of a hunk's header; one of no lines names the line before it."""
    return f"{start + (n > 0)}" + ("" if n == 1 else f",{n}")


def hunks(old: str, new: str, context: int = CONTEXT) -> tuple[int, int, str]:
    """(lines added, lines removed, hunks in unified form)."""
    a, b = lines(old), lines(new)
    blocks = _blocks(*kept(a, b))
    out: list[str] = []
    i = 0
    while i < len(blocks):
        j = i
        while j + 1 < len(blocks) and blocks[j + 1][0] - blocks[j][1] <= 2 * context:
            j += 1
        first, last = max(0, blocks[i][0] - context), min(len(a), blocks[j][1] + context)
        n = last - first + sum((y - x) - (q - p) for p, q, x, y in blocks[i : j + 1])
        out.append(f"@@ -{_range(first, last - first)} +{_range(blocks[i][2] - (blocks[i][0] - first), n)} @@\n")
        at = first
        for p, q, x, y in [*blocks[i : j + 1], (last, last, 0, 0)]:
            for sign, part in ((" ", a[at:p]), ("-", a[p:q]), ("+", b[x:y])):
                out += [sign + t if t.endswith("\n") else f"{sign}{t}\n{_NO_END}" for t in part]
            at = q
        i = j + 1
    return sum(y - x for _, _, x, y in blocks), sum(q - p for p, q, _, _ in blocks), "".join(out)


def _quoted(path: str) -> str:
    odd = any(c in path for c in _ESCAPES)
    return f'"{"".join(_ESCAPES.get(c, c) for c in path)}"' if odd else path


def patch(old_path: str, path: str, status: str, old: str, new: str, score: float = 1.0, context: int = CONTEXT) -> tuple[int, int, str]:
    """(lines added, lines removed, patch) of one file; a text with a NUL is binary and has no lines."""
    a, b = _quoted(f"a/{old_path}"), _quoted(f"b/{path}")
    head = [f"diff --git {a} {b}\n"]
    if status == "A":
        head.append("new file mode 100644\n")
    elif status == "D":
        head.append("deleted file mode 100644\n")
    elif status == "R":
        head.append(f"similarity index {int(100 * score)}%\nrename from {_quoted(old_path)}\nrename to {_quoted(path)}\n")
    if old == new:
        return 0, 0, "".join(head)
    a, b = "/dev/null" if status == "A" else a, "/dev/null" if status == "D" else b
    if "\0" in old or "\0" in new:
        return 0, 0, "".join(head) + f"Binary files {a} and {b} differ\n"
    added, removed, body = hunks(old, new, context)
    return added, removed, "".join(head) + f"--- {a}\n+++ {b}\n{body}"


def counts(old: str, new: str) -> tuple[int, int]:
    """(lines added, lines removed), as patch() has them."""
    if old == new or "\0" in old or "\0" in new:
        return 0, 0
    a, b = lines(old), lines(new)
    n = n_kept(a, b)
    return len(b) - n, len(a) - n


def apply(old: str, change: str) -> str:
    """The text that a patch of one file leads to; ValueError if it is not a patch of this text."""
    a, out, at = lines(old), [], 0
    left = right = 0
    sign = ""
    for line in lines(change):
        if line == _NO_END:
            if sign == "+":
                out[-1] = out[-1].removesuffix("\n")
        elif left or right:
            sign, text = line[:1], line[1:]
            if sign not in (" ", "-", "+"):
                raise ValueError("a hunk ends too soon")
            left, right = left - (sign != "+"), right - (sign != "-")
            if sign != "+":
                if at >= len(a) or a[at].rstrip("\n") != text.rstrip("\n"):
                    raise ValueError("a hunk does not fit")
                text, at = a[at], at + 1
            if sign != "-":
                out.append(text)
        elif header := _HEADER.match(line):
            start, left, right = int(header[1]), int(header[2] or 1), int(header[3] or 1)
            start -= left > 0
            if not at <= start <= len(a):
                raise ValueError("a hunk is out of place")
            out += a[at:start]
            at = start
        elif line.startswith("Binary files "):
            raise ValueError("a binary patch has no content")
    if left or right:
        raise ValueError("a hunk ends too soon")
    return "".join(out + a[at:])
