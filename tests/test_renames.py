"""Renames against all pairs and a plain greedy matching."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lodestack.operators import renames

SCHEMA = "commit string, path string, content string, score int"


def _score(a, b):
    x, y = (Counter(t.split("\n")) for t in (a, b))
    weigh = lambda c: sum(n * (len(t.encode()) + 1) for t, n in c.items())
    return weigh(x & y) / max(weigh(x), weigh(y))


def _plain(old, new, least=0.5):
    out = []
    for commit in {c for c, _, _ in old}:
        a, b = ([(p, t) for c, p, t in rows if c == commit and t] for rows in (old, new))
        exact = []
        for text in sorted({t for _, t in a}):
            exact += zip(sorted(p for p, t in a if t == text), sorted(p for p, t in b if t == text))  # noqa: B905
        out += [(commit, x, y, 1.0) for x, y in exact]
        a, b = [r for r in a if r[0] not in {x for x, _ in exact}], [r for r in b if r[0] not in {y for _, y in exact}]
        pairs = [(_score(t, u), p, q) for p, t in a for q, u in b]
        pairs = [x for x in pairs if x[0] >= least]
        while pairs:
            first = {}
            for s, p, q in pairs:
                for key, value in (((0, p), (-s, q, p)), ((1, q), (-s, p, q))):
                    first[key] = min(first.get(key, value), value)
            best = [(s, p, q) for s, p, q in pairs if first[0, p] == (-s, q, p) and first[1, q] == (-s, p, q)]
            out += [(commit, p, q, s) for s, p, q in best]
            pairs = [x for x in pairs if x[1] not in {b[1] for b in best} and x[2] not in {b[2] for b in best}]
    return out


def test_renames_equal_a_plain_matching(spark):
    rng = random.Random(12)
    old, new = [], []
    for c in range(4):
        base = [[f"line {rng.randrange(40)} é" if rng.random() < 0.7 else "" for _ in range(rng.randrange(1, 25))] for _ in range(8)]
        for i in range(14):
            text = list(rng.choice(base))
            old.append((f"c{c}", f"o{i}", "\n".join(text)))
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(len(text))] = f"new {rng.randrange(5)}"
            new.append((f"c{c}", f"n{rng.randrange(1000):03}", "\n".join(text)))
    old += [("c0", "empty", ""), ("c0", "null", None), ("c9", "alone", "x")]
    new += [("c0", "empty2", ""), ("c8", "alone", "x")]
    new = list({(c, p): (c, p, t) for c, p, t in new}.values())
    a, b = (spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3) for rows in (old, new))
    got = [(r[0], r[1], r[2], round(r[3], 9)) for r in renames.renames(a, b).collect()]
    want = [(c, p, q, round(s, 9)) for c, p, q, s in _plain(old, new)]
    assert sorted(got) == sorted(want) and len(want) > 20 and any(s < 1 for *_, s in want)
    scored = {(r[0], r[1], r[2]): round(r[3], 9) for r in renames.scores(a, b, 0.3).collect()}
    assert scored == {(c, p, q): round(s, 9) for c, p, t in old for d, q, u in new if c == d and t and u and (s := _score(t, u)) >= 0.3}


def test_renames_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert renames.renames(none, none).count() == 0


def test_scores_shuffle_files_and_no_pairs(spark):
    """Files that have all lines in common: pairs are made where blocks meet, and nothing is shuffled after that."""
    rows = lambda side, n: spark.createDataFrame([("c", f"{side}{i}", "\n".join(["same"] * 3 + [f"line{k}" for k in range(i % 7, 20)])) for i in range(n)], "commit string, path string, content string")
    out = renames.scores(rows("old", 40), rows("new", 30))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    size = lambda k: sum(len(f"line{x}") + 1 for x in range(k, 20)) + 15
    got = {(r.old_path, r.new_path): r.score for r in out.collect()}
    assert len(got) == 40 * 30 and all(abs(got[f"old{i}", f"new{j}"] - size(max(i % 7, j % 7)) / size(min(i % 7, j % 7))) < 1e-12 for i in range(40) for j in range(30))


def _packed(files, least=100):
    """Blocks of files that are lists of numbers of lines, each of `least` bytes or more."""
    size = np.array([sum(least + x % 300 for x in f) for f in files])
    lines, amounts = pa.array(files, pa.list_(pa.int64())), pa.array([[least + x % 300 for x in f] for f in files], pa.list_(pa.int32()))
    return list(renames._packed("c", pa.array([str(k) for k in range(len(files))]), size, lines, amounts))


def test_shared_bytes_in_each_way(monkeypatch):
    """Pairs that meet alone, products of matrices and a line's own table count alike, in parts of any size."""
    rng = random.Random(3)
    make = lambda n: [[rng.randrange(60) for _ in range(rng.randrange(1, 90))] + [7] * rng.randrange(400) + [1000 + k % 3] * rng.randrange(300) for k in range(n)]
    old, new = make(30), make(40)
    want = {(p, q): sum(n * (100 + x % 300) for x, n in (Counter(a) & Counter(b)).items()) for p, a in enumerate(old) for q, b in enumerate(new)}
    monkeypatch.setattr(renames, "BLOCK", 17)
    for times in (renames._TIMES, (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 0, 0)):
        for columns, cross in ((1 << 11, 1 << 18), (5, 7)):
            for name, value in (("_TIMES", times), ("_COLUMNS", columns), ("_CROSS", cross)):
                monkeypatch.setattr(renames, name, value)
            got = {}
            for a in _packed(old):
                for b in _packed(new):
                    x, y = (renames._Block(*(pa.scalar(v, pa.binary()) for v in (t[2], *t[5:]))) for t in (a, b))
                    got |= {(int(a[1][i]), int(b[1][j])): n for (i, j), n in np.ndenumerate(renames.shared_bytes(x, y))}
            assert got == want


def test_blocks_hold_lines_once():
    """What meets in memory is 4 bytes a line at most where files share lines, and a block has no more lines than its bound."""
    files = [list(range(k % 5, 500)) for k in range(1200)]
    blocks = _packed(files)
    assert sum(len(b[1]) for b in blocks) == 1200 and all(sum(len(files[int(p)]) for p in b[1]) <= renames.BLOCK_LINES for b in blocks)
    assert sum(len(x) for b in blocks for x in (b[2], *b[5:])) < 4 * sum(map(len, files))


def test_commits_meet_in_shares(spark, monkeypatch):
    """Files of many commits and one large one: pairs are sought in several products, none of which holds all blocks, and are all there."""
    rng = random.Random(8)
    text = lambda n: "\n".join(f"w{rng.randrange(9)}" for _ in range(n))
    rows = lambda side: [(f"c{c}", f"{side}{k}", text(rng.randrange(1, 25))) for c in range(7) for k in range(30 if c == 3 else 4)]
    old, new = rows("old"), rows("new")
    monkeypatch.setattr(renames, "SLICE_BYTES", 300, raising=False)
    monkeypatch.setattr(renames, "SHARE_BYTES", 1000, raising=False)
    out = renames.scores(*(spark.createDataFrame(x, "commit string, path string, content string") for x in (old, new)))
    assert out._jdf.queryExecution().executedPlan().toString().count("CartesianProduct") > 3
    got = {(r.commit, r.old_path, r.new_path): round(r.score, 9) for r in out.collect()}
    assert got == {(c, p, q): round(s, 9) for c, p, t in old for d, q, u in new if c == d and (s := _score(t, u)) >= 0.5} and len(got) > 50
