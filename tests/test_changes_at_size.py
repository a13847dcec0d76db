"""What changes shuffle and write: patches are made once, ties take no round each, counts need no patch."""

import random

from lodestack.operators import linediff, renames, snapshots

SCHEMA = "commit string, path string, content string"


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "commit string, old_path string, new_path string, score double")


def _greedy(rows):
    olds, news, out = set(), set(), set()
    for c, x, y, s in sorted(rows, key=lambda r: (r[0], -r[3], r[2], r[1])):
        if (c, x) not in olds and (c, y) not in news:
            olds.add((c, x))
            news.add((c, y))
            out.add((c, x, y, s))
    return out


def test_ties_take_no_round_each(spark, monkeypatch):
    n, kept, stored = 12, [], renames.stored
    monkeypatch.setattr(renames, "stored", lambda df, name: kept.append(name) or stored(df, name))
    old = spark.createDataFrame([("c", f"o{i:02}", "a\nb\nc\n") for i in range(n)], SCHEMA)
    new = spark.createDataFrame([("c", f"n{i:02}", "a\nb\nx\n") for i in range(n)], SCHEMA)
    got = {(r[1], r[2]) for r in renames.renames(old, new).collect()}
    assert got == {(f"o{i:02}", f"n{i:02}") for i in range(n)} and len(kept) <= 6


def test_rounds_and_order_match_alike(spark):
    rng = random.Random(4)
    rows = [(f"c{c}", f"o{i:02}", f"n{j:02}", rng.choice([0.5, 0.6, 0.75, 0.9])) for c in range(3) for i in range(14) for j in range(14) if rng.random() < 0.4]
    for few in (0, renames.FEW):
        assert {tuple(r) for r in renames.matched(_pairs(spark, rows), few).select("commit", "old_path", "new_path", "score").collect()} == _greedy(rows)
    assert renames.matched(_pairs(spark, [])).count() == 0


def test_patches_are_made_once(spark):
    old = spark.createDataFrame([("c", "a", "1\n2\n"), ("c", "b", "x\n"), ("c", "same", "y\n")], SCHEMA)
    new = spark.createDataFrame([("c", "a", "1\n3\n"), ("c", "d", "x\n"), ("c", "same", "y\n")], SCHEMA)
    out = snapshots.patched(old, snapshots.diff(old, new, least=None))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert {tuple(r) for r in out.collect()} == {("c", "a", "1\n3\n"), ("c", "d", "x\n"), ("c", "same", "y\n")}


def test_files_stay_beside_added_ones_of_their_path(spark):
    old = spark.createDataFrame([("c", "a", ""), ("c", "b", "x\n")], SCHEMA)
    change = spark.createDataFrame([("c", "a", "", "A", linediff.patch("a", "a", "A", "", "1\n")[2]), ("c", "b", "", "D", ""), ("c", "e", "b", "R", linediff.patch("b", "e", "R", "x\n", "z\n")[2])], "commit string, path string, old_path string, status string, patch string")
    assert sorted(tuple(r) for r in snapshots.patched(old, change).collect()) == [("c", "a", ""), ("c", "a", "1\n"), ("c", "e", "z\n")]


def test_texts_cross_once(spark):
    """One exchange a side has contents, whatever Spark broadcasts."""
    rows = [("c", f"f{i}", f"{i}\n") for i in range(50)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = snapshots.diff(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(c, p, "n" + t) for c, p, t in rows], SCHEMA), least=None)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 4  # contents and keys of either side


def test_counts_are_those_of_patches():
    rng = random.Random(5)
    for cells in (0, 30, linediff.CELLS):
        for _ in range(200):
            old, new = ("\n".join(str(rng.randrange(6)) for _ in range(rng.randrange(25))) + rng.choice(["", "\n"]) for _ in "ab")
            before, linediff.CELLS = linediff.CELLS, cells
            try:
                assert linediff.counts(old, new) == linediff.patch("p", "p", "M", old, new)[:2]
            finally:
                linediff.CELLS = before
    assert linediff.counts("a\0", "b") == (0, 0)


def test_counts_without_patches(spark):
    old = spark.createDataFrame([("c", "a", "1\n2\n"), ("c", "b", "x\n")], SCHEMA)
    new = spark.createDataFrame([("c", "a", "1\n3\n4\n")], SCHEMA)
    rows = {r["path"]: r for r in snapshots.diff(old, new, least=None, patches=False).collect()}
    assert [(r["status"], r["additions"], r["deletions"], r["patch"]) for r in (rows["a"], rows["b"])] == [("M", 2, 1, None), ("D", 0, 1, None)]
