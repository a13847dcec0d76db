"""Rules, aggregates, frameworks, similarity, embeddings and the stream on hand-written rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from lodestack.functions.registry import FRAMEWORKS
from lodestack.operators import duplication, embed, frameworks, languages, lines, metrics, review, rules, similarity
from lodestack.plans.analysis import analyse
from lodestack.streaming import incremental

FILES = "repo_id string, path string, content string"
FUNCTIONS = "repo_id string, file_path string, name string, start_line int, end_line int, loc int, complexity int, parameters array<string>, return_type string, is_exported boolean, comments string"


def functions(spark, rows):
    return spark.createDataFrame([("r", f"f{i}.go", name, i, i + loc - 1, loc, cx, ["p"] * n, None, True, "") for i, (name, loc, cx, n) in enumerate(rows, 1)], FUNCTIONS)


def test_rules_at_their_bounds(spark):
    f = functions(spark, [("a1", 50, 10, 0), ("b1", 51, 11, 0)])
    assert sorted((r["type"], r["severity"], r["line"]) for r in rules.issues(f).collect()) == [("complexity", "warning", 2), ("function_length", "warning", 2)]
    assert rules.complexity_issues(f).first()["message"] == "Function 'b1' has high complexity: 11"
    assert rules.naming_issues(functions(spark, [("x", 1, 1, 0), ("RUN", 1, 1, 0), ("run", 1, 1, 0)])).count() == 2


def test_ai_patterns_truth_table(spark):
    cases = list(itertools.product([0, 1], repeat=4))
    f = functions(spark, [("dataHelper" if g else "load", 101 if long else 100, 21 if cx else 20, 6 if p else 5) for g, long, cx, p in cases])
    got = {r["start_line"]: r["confidence"] for r in rules.ai_patterns(f).collect()}
    want = {i: 0.2 * g + 0.3 * lo + 0.3 * cx + 0.2 * p for i, (g, lo, cx, p) in enumerate(cases, 1) if ((0.2 * g + 0.3 * lo) + 0.3 * cx) + 0.2 * p > 0.5}
    assert set(got) == set(want) and len(got) == 6 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_totals_weight_the_average(spark):
    files = spark.createDataFrame([("r", "a.go", "x\n// c\n"), ("r", "b.go", ""), ("r", "e.go", "y")], FILES)
    f = functions(spark, [("a", 10, 2, 0), ("b", 20, 3, 0)]).withColumn("file_path", F.lit("a.go")).unionByName(functions(spark, [("c", 60, 1, 0)]).withColumn("file_path", F.lit("b.go")))
    stats = metrics.file_function_stats(files, f).withColumnRenamed("file_path", "path")
    assert {r["path"]: r["function_count"] for r in stats.collect()} == {"a.go": 2, "b.go": 1, "e.go": 0}
    total = metrics.repo_totals(lines.line_metrics(files).join(stats, ["repo_id", "path"]).withColumn("class_count", F.lit(0))).first()
    assert total["avg_function_length"] == 30 and total["max_function_length"] == 60 and total["cyclomatic_complexity"] == 6 and total["lines_of_code"] == 2 and total["comment_lines"] == 1


def test_top_is_a_prefix_of_the_full_order(spark):
    f = functions(spark, [(f"f{i}", i % 7, i % 5, 0) for i in range(40)])
    full = [r["name"] for r in f.orderBy(F.desc("complexity"), "repo_id", "file_path", "start_line").collect()]
    assert [r["name"] for r in metrics.top_by_complexity(f).collect()] == full[:10]
    assert "TakeOrdered" in metrics.top_by_length(f)._jdf.queryExecution().executedPlan().toString()


def test_languages(spark):
    files = spark.createDataFrame([("r", p, "") for p in ("a.go", "b.go", "c.py", "d.py", "vendor/x.go", "README.md")], FILES)
    counts = languages.language_counts(files)
    assert {r["language"]: r["n_files"] for r in counts.collect()} == {"Go": 2, "Python": 2}
    assert languages.primary_language(counts).first()["language"] == "Go"


def test_frameworks_from_manifests_and_content(spark):
    files = spark.createDataFrame(
        [
            ("a", "package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2", "nextish": "3"}}'), ("a", "src/x.ts", "useState() gin.New()"),
            ("b", "package.json", "not json"), ("b", "requirements.txt", "Django==4\nflask-x"), ("b", "build.gradle", "spring-boot-starter"), ("b", "sub/go.mod", "github.com/gin-gonic/gin"), ("b", "notes.md", "useState"),
            ("c", "pom.xml", "nothing"), ("c", "build.gradle", "spring-boot-starter"), ("c", "vendor/a.js", "useState"),
        ],
        FILES,
    )
    got = {}
    detected = frameworks.detect(files)
    for r in detected.orderBy("ordinal").collect():
        got.setdefault(r["repo_id"], []).append(r["name"])
    assert got == {"a": ["React", "Vite", "Gin"], "b": ["Flask", "Spring Boot"]}
    assert [r["name"] for r in frameworks.detect(files, language_filter=True).where("repo_id = 'a'").orderBy("ordinal").collect()] == ["React", "Vite"]
    assert [r["pattern"] for r in frameworks.patterns(detected).where("repo_id = 'a'").orderBy("ordinal").collect()] == ["Component-based Architecture", "Router → Handler → Service"]
    assert [r["type"] for r in frameworks.by_type(detected).where("repo_id = 'a'").orderBy("rank").collect()] == ["Backend", "UI", "Build"]
    assert {r["path"] for r in frameworks.important_files(files).where("repo_id = 'b'").collect()} == {"package.json", "requirements.txt", "build.gradle"}


def test_a_file_that_lists_indicators_shows_all_frameworks(spark):
    text = "\n".join(i for f in FRAMEWORKS for i in f.indicators)
    files = spark.createDataFrame([("r", "registry.go", text)], FILES)
    assert frameworks.content_hits(files).count() == len(FRAMEWORKS) == 30


def _vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, [1.0]), (7, None)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_search_and_duplicates(spark):
    v = _vectors(spark)
    q = F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float"))
    assert [r["id"] for r in similarity.search_one(v, q, 3).collect()] == [1, 2, 3]
    assert similarity.search_one(v, q, 100).count() == 6 and similarity.search_one(v, q, -1).count() == 0
    got = {(r["query_id"], r["rank"]): r["id"] for r in similarity.search(v, v.where("id in (1, 4)"), 2, exclude_self=True, query_block=1).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (4, 1): 3, (4, 2): 1}
    assert [(r["id_a"], r["id_b"]) for r in similarity.similar_pairs(v, 0.9, block=2).collect()] == [(1, 3)]
    assert {r["id"]: r["class_id"] for r in similarity.classes(v).collect()}[2] == 1
    assert sum(r["n"] for r in similarity.level_histogram(v, block=2).collect()) == 10
    assert [r["id"] for r in similarity.find_duplicates(v, q, 1, 0).collect()] == [2, 3]
    m = spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "f")], "file_path string, func_name string")
    assert similarity.without_self(m, "a", "f").count() == 2


def test_duplicate_blocks(spark):
    files = spark.createDataFrame([("a", "x\ny\n\nz\nq"), ("b", " x\ny\nz"), ("c", "")], "path string, content string")
    r = duplication.duplicate_blocks(files, 3).collect()
    assert len(r) == 1 and (r[0]["n_places"], r[0]["first_path"], r[0]["first_line"]) == (2, "a", 1)


def test_duplicate_blocks_count_files_exactly(spark):
    files = spark.range(3000).selectExpr("concat('f', id % 1500) as path", "'x\\ny\\nz\\nx\\ny\\nz' as content")
    r = {x["n_places"]: x["n_files"] for x in duplication.duplicate_blocks(files, 3).collect()}
    assert r == {6000: 1500, 3000: 1500}


def test_search_by_text_and_duplicates_of_a_function(spark):
    f = functions(spark, [("loadRow", 5, 1, 0), ("loadRow", 5, 1, 0), ("other", 90, 7, 3)])
    provider = embed.HashingProvider(64)
    index = embed.embed(embed.describe(f), provider)
    text = index.where("func_name = 'other'").first()["code"]
    assert [r["func_name"] for r in similarity.search_text(index, provider, text, 1).collect()] == ["other"]
    text = index.where("file_path = 'f1.go'").first()["code"]
    assert [r["file_path"] for r in similarity.detect_duplicates(index, provider, text, "f1.go", "loadRow", 0.99).collect()] == ["f2.go"]
    assert similarity.search_text(index, embed.HashingProvider(32), text, 5).count() == 0


class Flaky:
    name = "flaky"

    def embed(self, text):
        raise ValueError("down")


def test_embeddings_keep_failures_and_refresh(spark):
    f = functions(spark, [("a", 1, 1, 2), ("b", 2, 1, 0)])
    d = embed.describe(f)
    assert d.where("func_name = 'a'").first()["code"] == "// Language: Go\n// Function: a\n// Parameters: [p p]\n// Complexity: 1\n// Lines: 1\n"
    bad = embed.embed(d, Flaky()).collect()
    assert len(bad) == 2 and all(r["embedding"] is None and "down" in r["error"] for r in bad)
    good = embed.embed(d, embed.Chain([Flaky(), embed.HashingProvider(16)]))
    assert {r["provider"] for r in good.collect()} == {"hashing"} and {r["dim"] for r in good.collect()} == {16}
    changed = embed.describe(functions(spark, [("a", 1, 1, 2), ("c", 2, 1, 0)]))
    again = embed.refreshed(changed, good, Flaky())
    assert {r["func_name"]: r["error"] is None for r in again.collect()} == {"a": True, "c": False}
    with pytest.raises(ValueError):
        embed.Chain([Flaky()]).embed("x")


def test_changes_default_status_and_patch(spark):
    numstat = spark.createDataFrame([("c", "3\t1\ta"), ("c", "-\t-\tb"), ("c", "bad")], "commit string, line string")
    statuses = spark.createDataFrame([("c", "a", "A")], "commit string, path string, status string")
    patches = spark.createDataFrame([("c", "b", "P")], "commit string, path string, patch string")
    out = review.changes(numstat, statuses, patches)
    assert {(r["path"], r["status"], r["additions"], r["patch"]) for r in out.collect()} == {("a", "A", 3, ""), ("b", "M", 0, "P")}
    assert review.full_diff(out).first()["patch"] == "P" and review.diff_summary(out).first()["n_files"] == 2


def test_unparseable_files_count_in_no_total(spark):
    files = spark.createDataFrame([("r", "a.go", "package p\n\nfunc F() {\n}\n"), ("r", "b.go", "package p\nfunc {"), ("r", "c.py", "x = 1\n")], FILES)
    t = analyse(files, provider=embed.HashingProvider(8))
    total = t["totals"].first()
    assert (total["file_count"], total["lines_of_code"], total["function_count"]) == (2, 4, 1)
    assert [r["path"] for r in t["errors"].collect()] == ["b.go"] and t["embeddings"].count() == 1


def test_stream_keeps_the_newest_version(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    for rows in ([("r", "a.go", "x\n", 1), ("r", "b.go", "y\n", 1)], [("r", "a.go", "x\n// c\nz\n", 2), ("r", "b.go", None, 2)]):
        spark.createDataFrame(rows, incremental.VERSIONS).write.mode("append").parquet(source)
        incremental.follow(incremental.read_versions(spark, source), table, checkpoint).awaitTermination(120)
    assert [(r["path"], r["lines_of_code"], r["comment_lines"]) for r in incremental.current(spark, table).collect()] == [("a.go", 2, 1)]


def test_indicators_in_one_pass():
    """Overlapping words, words within words, empty words; and thousands of words cost about what thirty do."""
    import random
    import time

    from lodestack.operators.frameworks import words_in

    words = (("use", "useState"), ("State(",), ("",), ("eSt", "zzz"), (), ("State", "useState("), ("é漢",))
    for text in ("", "const x = useState(1)", "us eState", "é漢", "useuseState"):
        assert words_in(text, words) == {k for k, some in enumerate(words) if any(w in text for w in some)}
    rng = random.Random(2)
    many = tuple((f"{rng.getrandbits(60):x}", f"{rng.getrandbits(60):x}") for _ in range(2500))
    text = " ".join(f"{rng.getrandbits(60):x}" for _ in range(50_000)) + many[77][0]
    assert words_in(text, many) == {77} and words_in(text, many[:15]) == set()

    def seconds(some):
        began = time.perf_counter()
        for _ in range(5):
            words_in(text, some)
        return time.perf_counter() - began

    assert min(seconds(many) for _ in range(3)) < 5 * min(seconds(many[:15]) for _ in range(3))


def test_own_registries(spark):
    from lodestack.functions.registry import Framework
    from lodestack.operators import frameworks

    own = [Framework("Own", "Backend", "Go", ("ownword",), ("own",)), Framework("Other", "UI", "Python", ("word",), ("other",)), Framework("None", "UI", "Go", (), ("none",))]
    files = spark.createDataFrame([("r", "a.go", "my ownword"), ("r", "vendor/b.go", "word"), (None, "c.py", "a word"), ("s", "d.txt", "word"), ("t", "e.go", None)], "repo_id string, path string, content string")
    rows = lambda **more: sorted(map(repr, map(tuple, frameworks.content_hits(files, own, **more).collect())))
    assert rows() == sorted(map(repr, [("r", 0), ("r", 1), (None, 1)]))
    assert rows(language_filter=True) == sorted(map(repr, [("r", 0), (None, 1)]))
    assert frameworks.content_hits(files, []).count() == 0
