"""Filters that go to the git source, partitions by number, and the stream of commits."""

import subprocess

import pytest

from lodestack.sources import git


def _git(root, *args):
    return subprocess.run(["git", "-c", "user.name=A", "-c", "user.email=a@b", "-C", str(root), *args], check=True, capture_output=True, text=True).stdout


def _commit(root, n):
    for k in range(3):
        (root / f"f{k}.go").write_text(f"package p\n// {n * (k + 1)}\n" + "// filler\n" * 9)
    if n == 3:
        _git(root, "mv", "f2.go", "moved.go")
    (root / f"only{n}.txt").write_text(str(n))
    _git(root, "add", "-A")
    _git(root, "commit", "-m", f"c{n}")


@pytest.fixture
def root(tmp_path):
    path = tmp_path / "r"
    path.mkdir()
    _git(path, "init", "-b", "main")
    for n in range(1, 8):
        _commit(path, n)
    return path


@pytest.fixture
def read(spark, root):
    git.register(spark)
    return lambda **o: spark.read.format("git").options(path=str(root), **o).load()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_go_to_the_source(read, root):
    names = _git(root, "rev-list", "HEAD").split()
    everything = read(table="diff_files").collect()
    for condition, keep in (
        (f"commit = '{names[2]}'", lambda r: r["commit"] == names[2]),
        (f"commit IN ('{names[0]}', '{names[6]}', 'no such', '{'0' * 40}')", lambda r: r["commit"] in (names[0], names[6])),
        ("path = 'moved.go'", lambda r: r["path"] == "moved.go"),
        (f"path = 'f0.go' AND status = 'M' AND commit = '{names[1]}'", lambda r: r["path"] == "f0.go" and r["status"] == "M" and r["commit"] == names[1]),
        ("path IN ('f1.go', 'only3.txt') AND additions > 5", lambda r: r["path"] in ("f1.go", "only3.txt") and r["additions"] > 5),
        ("status = 'R'", lambda r: r["status"] == "R"),
        ("path = 'f0.go' AND path = 'f1.go'", lambda r: False),
        ("path LIKE 'only%'", lambda r: r["path"].startswith("only")),
    ):
        assert sorted(read(table="diff_files").where(condition).collect()) == sorted(r for r in everything if keep(r)), condition
    plan = _plan(read(table="diff_files").where(f"commit = '{names[2]}' AND path = 'f0.go' AND length(patch) > 3"))
    assert "length(patch" in plan and names[2] not in plan.split("length(patch")[0] and "= f0.go" not in plan
    assert [r["message"] for r in read().where(f"hash = '{names[1]}'").collect()] == ["c6"]
    assert read(range="HEAD~2..HEAD").where(f"hash = '{names[4]}'").count() == 0 and read(range="HEAD~2..HEAD").where(f"hash = '{names[1]}'").count() == 1
    assert read(latest="true").where(f"hash = '{names[1]}'").count() == 0 and read(latest="true").where(f"hash = '{names[0]}'").count() == 1
    assert [(r["path"], r["content"][:14]) for r in read(table="content").where(f"commit = '{names[0]}' AND path = 'f1.go'").collect()] == [("f1.go", "package p\n// 1")]
    assert {r["path"] for r in read(table="range_diff", range="HEAD~1..HEAD").where("status = 'A'").collect()} == {"only7.txt"}
    with pytest.raises(Exception, match="unknown revision|no such|rev-parse"):
        read(range="no-such").count()


def test_partitions_by_number(root, monkeypatch):
    monkeypatch.setattr(git, "COMMITS_PER_PARTITION", 2)
    names = _git(root, "rev-list", "HEAD").split()
    reader = git._Reader({"path": str(root)})
    runs = reader.partitions()
    assert [(r.names, r.skip, r.count) for r in runs] == [(None, 0, 2), (None, 2, 2), (None, 4, 2), (None, 6, 1)]
    _commit(root, 8)  # what comes between planning and reading changes nothing
    assert [row[0] for r in runs for row in reader.read(r)] == names
    monkeypatch.setattr(git, "MOST_PARTITIONS", 2)
    assert [r.count for r in git._Reader({"path": str(root)}).partitions()] == [4, 4]
    monkeypatch.setattr(git, "MOST_NAMES", 1)
    many = git._Reader({"path": str(root)})
    many.only["commit"] = {names[1], names[5]}
    assert [row[0] for r in many.partitions() for row in many.read(r)] == [names[1], names[5]]


def test_stream_reads_each_commit_once(spark, root, tmp_path):
    git.register(spark)
    out, kept = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(**options):
        query = spark.readStream.format("git").options(path=str(root), **options).load().writeStream.format("parquet").option("checkpointLocation", kept).start(out)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r["message"] for r in spark.read.parquet(out).collect())

    assert run(after="HEAD~3") == ["c5", "c6", "c7"]
    assert run() == ["c5", "c6", "c7"]
    _commit(root, 8)
    _commit(root, 9)
    assert run() == ["c5", "c6", "c7", "c8", "c9"]
    _git(root, "reset", "--hard", "HEAD~1")  # a branch that is rewritten: only what is new comes
    _commit(root, 10)
    assert run() == ["c10", "c5", "c6", "c7", "c8", "c9"]


def test_stream_of_a_range_is_refused(spark, root):
    with pytest.raises(ValueError, match="one revision"):
        git._StreamReader({"path": str(root), "range": "A..B"})


def test_outputs_kept_as_text(spark):
    rows = [("c", "1\t2\ta b\0-\t-\t\0x\0y|z\0", "A\0a b\0R100\0x\0y|z\0", 1), ("d", None, None, 2), ("e", "3\t0\tq\0", "", 3)]
    out = git.read_outputs(spark.createDataFrame(rows, "commit string, numstat string, name_status string, path int"))
    assert sorted(map(tuple, out.collect())) == [("c", "a b", "", "A", 1, 2), ("c", "y|z", "x", "R", 0, 0), ("e", "q", "", "M", 3, 0)]
    assert git.read_outputs(spark.createDataFrame([], "commit string, numstat string, name_status string")).count() == 0
