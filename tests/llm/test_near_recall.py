"""Near duplicates by kind of edit, length and similarity: all that are similar are linked, and nothing else."""

import random
from collections import Counter

import pytest

from lodestack.llm import near_text

LENGTHS = {"10-30": (10, 30), "30-100": (30, 100), "100-300": (100, 300), "300-1000": (300, 1000)}
KINDS = ["tail", "head", "middle", "cut tail", "cut head", "scattered", "inserted"]
BANDS = [(0.80, 0.85), (0.85, 0.90), (0.90, 1.0)]


def _shingles(w):
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _similarity(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b)


def _edited(rng, w, kind, k):
    """w with k words edited."""
    new = [f"e{rng.randrange(10**9)}" for _ in range(k)]
    at = rng.randrange(1, max(2, len(w) - k))
    if kind == "tail":
        return w[: len(w) - k] + new
    if kind == "head":
        return new + w[k:]
    if kind == "middle":
        return w[:at] + new + w[at + k :]
    if kind == "cut tail":
        return w[: len(w) - k]
    if kind == "cut head":
        return w[k:]
    if kind == "inserted":
        return w[:at] + new + w[at:]
    out = list(w)
    for i, x in zip(rng.sample(range(len(w)), k), new, strict=True):
        out[i] = x
    return out


def _cases(rng, vocabulary):
    """(words, edited words, kind, length, band); pairs just under the threshold have no band."""
    for kind in KINDS:
        for length, (least, most) in LENGTHS.items():
            for band in [*BANDS, None]:
                low, high = band or (0.7, 0.8)
                for _ in range(4):
                    w = [rng.choice(vocabulary) if vocabulary else f"w{rng.randrange(10**9)}" for _ in range(rng.randint(least, most))]
                    for k in range(1, len(w)):
                        other = _edited(rng, w, kind, k)
                        s = _similarity(w, other)
                        if s < low:
                            break
                        if s < high:
                            yield w, other, kind, length, band
                            break


@pytest.mark.parametrize("shared_words", [False, True])
def test_all_similar_texts_are_linked(spark, shared_words):
    rng = random.Random(31)
    cases = list(_cases(rng, [f"v{i}" for i in range(400)] if shared_words else None))
    rows = [(2 * i + j, " ".join(x)) for i, c in enumerate(cases) for j, x in enumerate(c[:2])]
    got = {r["doc_id"]: r["group_id"] for r in near_text.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    total, found = Counter(), Counter()
    for i, (_, _, kind, length, band) in enumerate(cases):
        linked = got[2 * i + 1] == got[2 * i]
        if band is None:
            assert not linked, (kind, length)
        else:
            total[kind, length, band] += 1
            found[kind, length, band] += linked
    assert sum(total.values()) > 150 and found == total
    assert {k[0] for k in total} == set(KINDS) and {k[1] for k in total} == set(LENGTHS)


def test_outsiders_of_a_large_group_join_it(spark):
    """Texts with a new tail, whose fingerprints are far from those of the group that their other words are of."""
    rng = random.Random(32)
    base = [f"b{rng.randrange(10**9)}" for _ in range(150)]
    texts = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(100)] = f"c{i}"
        texts.append(w)
    for i in range(120):
        k = rng.randrange(8, 14)
        texts.append(base[: 150 - k] + [f"t{i}x{j}" for j in range(k)])
    want = list(range(len(texts)))
    sets = [_shingles(w) for w in texts]
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["group_id"] for r in near_text.groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want[600:])) < 120
