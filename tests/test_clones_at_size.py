"""Pairs of clones are made once, in tasks that follow their number."""

import re

from lodestack.operators import clones


def test_pairs_are_made_once_and_by_their_number(spark, monkeypatch):
    body = "\n".join(f"  x = x {'+-*'[k * k % 3]} y" for k in range(30))
    df = spark.createDataFrame([("r", f"f{k:02}.go", f"package p\n\nfunc run{k}(x int) {{\n{body}\n}}\n") for k in range(60)], "repo_id string, path string, content string")
    whole = sorted(map(tuple, clones.clone_pairs(df).collect()))
    assert len(whole) >= 59
    dealt = []

    def spy(self, n, *by):
        dealt.append((n, by))
        return repartition(self, n, *by)

    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", spy)
    monkeypatch.setattr(clones, "PAIRS_A_TASK", 8)
    pairs = clones.clone_pairs(df)
    assert dealt == [(8, ("file_a", "share"))]
    assert sorted(map(tuple, pairs.collect())) == whole
    plan = clones.clone_classes(pairs)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1
    # a stream of the earlier file goes to no more rows than there are shares
    monkeypatch.setattr(clones, "SHARES", 4)
    assert sorted(map(tuple, clones.clone_pairs(df).collect())) == whole
    assert sorted(map(tuple, clones.clone_classes(clones.clone_pairs(df)).collect()))[0][-3] >= 60


def test_tokens_that_were_seen_are_the_same(spark):
    text, known = 'package p // x\n\nfunc f() {\n s := `a\nb` + "c" }\n', {}
    for _ in range(2):
        codes, exact, first, last = clones.tokens(text, known)
        assert first.tolist() == [1, 1, 3, 3, 3, 3, 3, 4, 4, 4, 5, 5, 5] and last.tolist() == [1, 1, 3, 3, 3, 3, 3, 4, 4, 5, 5, 5, 5]
        assert len(codes) == len(exact) == 13
    assert "f" in known and [len(x) for x in clones.tokens("")] == [0] * 4
