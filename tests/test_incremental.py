"""A table of metrics that follows file versions: replays, late versions, deletions, size."""

import random

from lodestack import store
from lodestack.streaming import incremental


def _batch(spark, rows):
    return spark.createDataFrame([("r", p, c, v) for p, c, v in rows], incremental.VERSIONS)


def _lines(spark, table):
    return {r["path"]: r["lines_of_code"] for r in incremental.current(spark, table).collect()}


def test_late_versions_and_deletions(spark, tmp_path):
    table = str(tmp_path / "t")
    incremental.merge(_batch(spark, [("a.go", "x\n", 1), ("b.go", "y\ny\n", 5), ("a.go", "x\nx\nx\n", 3)]), 0, table, buckets=4)
    assert _lines(spark, table) == {"a.go": 3, "b.go": 2}
    incremental.merge(_batch(spark, [("a.go", "late\n", 2), ("b.go", None, 6), ("c.go", "z\n", 1)]), 1, table, buckets=4)
    assert _lines(spark, table) == {"a.go": 3, "c.go": 1}
    incremental.merge(_batch(spark, [("b.go", "late\n", 4)]), 2, table, buckets=4)
    assert _lines(spark, table) == {"a.go": 3, "c.go": 1}
    incremental.merge(_batch(spark, [("b.go", "again\n", 7), ("a.go", None, 9), ("skip.md", "x", 1), ("n.go", "x", None)]), 3, table, buckets=4)
    assert _lines(spark, table) == {"b.go": 1, "c.go": 1}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    incremental.merge(_batch(spark, [("a.go", "x\n", 1)]), 0, table)
    before = store.pointed(spark, table)
    incremental.merge(_batch(spark, [("a.go", "other\nother\n", 8)]), 0, table)
    assert store.pointed(spark, table) == before and _lines(spark, table) == {"a.go": 1}
    # a batch that was written but not switched to is written again
    (tmp_path / "t" / "batch-1" / "bucket=0").mkdir(parents=True)
    incremental.merge(_batch(spark, [("a.go", "x\nx\n", 2)]), 1, table)
    assert _lines(spark, table) == {"a.go": 2}


def test_the_table_stays_as_large_as_the_files(spark, tmp_path):
    table, rng, live, version = str(tmp_path / "t"), random.Random(3), {}, 0
    for epoch in range(6):
        rows = []
        for _ in range(40):
            version += 1
            path = f"f{rng.randrange(25)}.go"
            text = None if rng.random() < 0.3 else "x\n" * rng.randrange(1, 9)
            rows.append((path, text, version))
            live[path] = text
        rng.shuffle(rows)
        incremental.merge(_batch(spark, rows), epoch, table, buckets=5, horizon=10)
        assert _lines(spark, table) == {p: t.count("\n") for p, t in live.items() if t}
    deleted = incremental.stored_rows(spark, table).where("lines_of_code is null").collect()
    assert all(r["version"] >= version - 40 - 10 for r in deleted)
    folders = [f for b in (tmp_path / "t").iterdir() if b.is_dir() for f in b.iterdir() if f.is_dir()]
    assert len(folders) <= 2 * 5
    incremental.merge(_batch(spark, [("new.go", "too late\n", version - 11), ("new2.go", "x\n", version)]), 6, table, buckets=5, horizon=10)
    assert "new.go" not in _lines(spark, table) and _lines(spark, table)["new2.go"] == 1


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = str(tmp_path / "t")
    incremental.merge(_batch(spark, [(f"f{i}.go", "x\n", 1) for i in range(200)]), 0, table, buckets=8)
    incremental.merge(_batch(spark, [("f0.go", "x\nx\n", 2)]), 1, table, buckets=8)
    assert len(store.folders_in(spark, f"{table}/batch-1")) == 1 and len(_lines(spark, table)) == 200 and _lines(spark, table)["f0.go"] == 2


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    for rows in ([("a.go", "x\n", 1)], [("a.go", "x\nx\n", 2), ("b.go", "y\n", 1)], [("b.go", None, 2)]):
        _batch(spark, rows).write.mode("append").parquet(source)
        incremental.follow(incremental.read_versions(spark, source), table, checkpoint, buckets=4).awaitTermination(120)
    assert _lines(spark, table) == {"a.go": 2}


def test_an_empty_table(spark, tmp_path):
    assert incremental.current(spark, str(tmp_path / "none")).count() == 0
    incremental.merge(_batch(spark, []), 0, str(tmp_path / "t"))
    assert incremental.current(spark, str(tmp_path / "t")).count() == 0
