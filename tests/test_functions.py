"""Scalar expressions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from lodestack.functions import scalar as s


def values(spark, rows, expression, column="x"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {column} string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_language_by_extension(spark):
    paths = ["a/b.TSX", "x.tar.gz", "a.b/c", ".go", "p.KTS", "dir/.h", "a.hpp", "noext", "", "x."]
    assert values(spark, paths, s.language_of(F.col("x"))) == ["TypeScript", "Unknown", "Unknown", "Go", "Kotlin", "C", "C++", "Unknown", "Unknown", "Unknown"]


def test_pruned_directories(spark):
    paths = ["src/main.go", "vendored/a.go", "build.go", "a/vendor/x.go", ".git/x", "x/target/y", "node_modules/a.js", "a/.hidden/b.py", "dist/x", "__pycache__/x.py"]
    assert values(spark, paths, s.is_pruned(F.col("x"))) == [False] * 3 + [True] * 7


def test_lines_and_comments(spark):
    texts = ["", "\n", "a\n\n", "#", "# x", "/* x */\n * y\n", "\t// c\r\n \r\ncode", None]
    got = values(spark, texts, F.transform(s.lines(F.col("x")), lambda x: F.when(s.trimmed(x) == "", "b").when(s.is_comment(x), "c").otherwise("x")))
    assert ["".join(g) for g in got] == ["", "b", "xb", "x", "c", "cx", "cbx", ""]


def test_names(spark):
    names = ["x", "RUN", "_1", "run", "é", "NewFactoryX", "HTTPUTIL"]
    assert values(spark, names, s.has_invalid_name(F.col("x"))) == [True, True, True, False, False, False, True]
    assert values(spark, names, s.is_generic_name(F.col("x"))) == [False] * 5 + [True, True]


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [-1.0, 0.0], -1), ([1.0], [1.0, 2.0], 0), ([0.0, 0.0], [1.0, 2.0], 0), ([1.0, 0.0], [0.0, 3.0], 0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    r = df.select(s.cosine(F.col("a"), F.col("b")).alias("c"), s.cosine(F.col("b"), F.col("a")).alias("d"))
    assert dict(r.dtypes)["c"] == "float" and abs(r.first()["c"] - want) < 1e-6 and r.first()["c"] == r.first()["d"]


def test_similarity_levels(spark):
    df = spark.createDataFrame([(x,) for x in (0.95, 0.85, 0.75, 0.60, 0.59)], "x float")
    assert [r[0] for r in df.select(s.similarity_level(F.col("x"))).collect()] == ["Nearly Identical", "Very Similar", "Similar", "Somewhat Similar", "Different"]


def test_commit_and_numstat_lines(spark):
    got = values(spark, ["abcdefghij|n|e|1700000000|s|t", "too|few"], s.commit_fields(F.col("x")))
    assert got[0]["short_hash"] == "abcdefg" and got[0]["message"] == "s|t" and got[1] is None
    got = values(spark, ["3\t1\ta b.go", "-\t-\tb.png", "short"], s.numstat_fields(F.split("x", "\t", 3)))
    assert [g and (g["additions"], g["deletions"], g["path"]) for g in got] == [(3, 1, "a b.go"), (0, 0, "b.png"), None]


def test_statuses_and_icons(spark):
    assert values(spark, ["", "A", None], s.shown_status(F.col("x"))) == ["M", "A", "M"]
    assert values(spark, ["warning", "error", "info"], s.severity_icon(F.col("x"))) == ["⚠️", "❌", "ℹ️"]


def test_row_id(spark):
    import hashlib

    df = spark.createDataFrame([("a.go", "f", 3)], "p string, n string, l int")
    assert df.select(s.row_id(F.col("p"), F.col("n"), F.col("l"))).first()[0] == hashlib.sha256(b"a.go:f:3").hexdigest()[:16]
