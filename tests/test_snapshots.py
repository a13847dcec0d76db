"""Line differences against a plain longest common subsequence; snapshots, their changes and back."""

import random

import pytest

from lodestack.operators import hunks, linediff, snapshots
from lodestack.sources.git import patch_path

SCHEMA = "commit string, path string, content string, hash int"


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        nxt = [0]
        for j, y in enumerate(b):
            nxt.append(row[j] + 1 if x == y else max(row[j + 1], nxt[j]))
        row = nxt
    return row[-1]


def _text(rng, words, kinds):
    return "\n".join(str(rng.randrange(kinds)) for _ in range(words)) + rng.choice(["", "\n"])


@pytest.mark.parametrize("cells", [0, 40, linediff.CELLS])
def test_differences_are_shortest_and_apply(cells, monkeypatch):
    monkeypatch.setattr(linediff, "CELLS", cells)
    rng = random.Random(1)
    for _ in range(800):
        kinds = rng.choice([1, 2, 3, 8, 30])
        old = _text(rng, rng.randrange(30), kinds)
        new = _text(rng, rng.randrange(30), kinds) if rng.random() < 0.5 else "".join(x if rng.random() < 0.8 else f"{rng.randrange(40)}\n" for x in linediff.lines(old) if rng.random() < 0.9)
        a, b = linediff.lines(old), linediff.lines(new)
        n = _common(a, b)
        x, y = linediff.kept(a, b)
        assert [t for t, k in zip(a, x, strict=True) if k] == [t for t, k in zip(b, y, strict=True) if k] and x.sum() == n
        added, removed, patch = linediff.patch("p", "p", "M", old, new, context=rng.randrange(4))
        assert (added, removed) == (len(b) - n, len(a) - n) and linediff.apply(old, patch) == new
        assert sum(max(0, last - first + 1) for first, last in hunks.ranges(patch)) == added


def test_a_long_text():
    rng = random.Random(2)
    old = [f"{rng.randrange(4000)}\n" for _ in range(100_000)]
    new = [x for i, x in enumerate(old) if i % 997]
    added, removed, patch = linediff.patch("p", "p", "M", "".join(old), "".join(new))
    assert (added, removed) == (0, 101) and linediff.apply("".join(old), patch) == "".join(new)


def test_patches_that_do_not_fit():
    _, _, patch = linediff.patch("p", "p", "M", "a\nb\n", "a\nc\n")
    for text, change in (("a\nx\n", patch), ("", patch), ("a\nb\n", patch[:-3]), ("a", "Binary files a/p and b/p differ\n")):
        with pytest.raises(ValueError):
            linediff.apply(text, change)


def _snapshots(rng):
    old, new = {}, {}
    for c in ("c0", "c1"):
        for i in range(40):
            text = _text(rng, rng.randrange(40), 50)
            name = f"f{i}"
            kind = rng.randrange(6)
            if kind != 0:
                old[c, name] = text
            if kind == 1:
                new[c, f"to{i}"] = text.replace("7\n", "77\n")
            elif kind == 2:
                new[c, name] = text
            elif kind != 3:
                new[c, name] = "".join(x for x in linediff.lines(text) if rng.random() < 0.8)
    old |= {("c0", 'qu"o\tte é'): "1\n2\n3\n4\n", ("c0", "null"): None, ("c0", "some"): "x", ("c2", "alone"): "x"}
    new |= {("c0", 'new "name'): "1\n2\n3\n4\n5", ("c0", "null"): "", ("c0", "some"): None}
    return old, new


def _table(spark, files):
    return spark.createDataFrame([(*k, v, 1) for k, v in files.items()], SCHEMA).repartition(3)


def test_snapshots_there_and_back(spark):
    rng = random.Random(3)
    old, new = _snapshots(rng)
    a, b = _table(spark, old), _table(spark, new)
    changes = snapshots.diff(a, b.unionByName(b))
    rows = changes.collect()
    by_path = {(r["commit"], r["path"]): r for r in rows}
    assert len(by_path) == len(rows) and {r["status"] for r in rows} == set("AMDR")
    for (c, p), r in by_path.items():
        source = (c, r["old_path"] or p)
        x, y = old.get(source) or "", new.get((c, p)) or ""
        n = _common(linediff.lines(x), linediff.lines(y))
        assert r["status"] == ("R" if r["old_path"] else "M" if (c, p) in old and (c, p) in new else "D" if (c, p) in old else "A")
        assert (r["additions"], r["deletions"]) == (len(linediff.lines(y)) - n, len(linediff.lines(x)) - n)
        assert patch_path(r["patch"]) == p
    assert by_path["c0", 'new "name']["old_path"] == 'qu"o\tte é' and ("c0", "null") not in by_path and by_path["c0", "some"]["deletions"] == 1
    got = {(r[0], r[1]): r[2] for r in snapshots.patched(a, changes).collect()}
    assert got == {k: v or "" for k, v in new.items()}
    assert {r["status"] for r in snapshots.diff(a, b, least=None).collect()} == set("AMD")


def test_snapshots_of_awkward_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert snapshots.diff(none, none).count() == 0 and snapshots.patched(none, snapshots.diff(none, none)).count() == 0
    odd = spark.createDataFrame([(None, "p", "x", 1), ("c", None, "x", 1), ("c", "b", "a\0b", 1), ("c", "p", "1", 1), ("c", "p", "2", 2)], SCHEMA)
    rows = {r["path"]: r for r in snapshots.diff(none, odd).collect()}
    assert set(rows) == {"b", "p"} and rows["b"]["patch"].endswith("Binary files /dev/null and b/b differ\n") and rows["b"]["additions"] == 0
    assert rows["p"]["additions"] == 1
