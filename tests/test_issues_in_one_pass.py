"""Issues of both kinds come from one pass over what gives the functions."""

from lodestack.operators import goparse, rules

FUNCTIONS = "repo_id string, file_path string, name string, start_line int, loc int, complexity int"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_parsed_once(spark):
    files = spark.createDataFrame([("r", "a.go", "package p\n\nfunc f() {\n" + "  if x { }\n" * 60 + "}\n"), ("r", "b.go", "no")], "repo_id string, path string, content string")
    found = rules.issues(goparse.functions_of(goparse.parse_go(files, with_content=False)))
    assert _plan(found).count("MapInPandas") == 1
    assert sorted(r["type"] for r in found.collect()) == ["complexity", "function_length"]


def test_issues_are_those_of_either_kind(spark):
    rows = [("r", "a", "f", 1, 51, 11), ("r", "a", "g", 2, 50, 11), (None, "a", "h", 3, 51, 10), ("r", None, "i", 4, 1, 1), ("r", "b", None, 5, None, 20), ("r", "b", "k", 6, 90, None)]
    f = spark.createDataFrame(rows, FUNCTIONS)
    both = rules.complexity_issues(f).unionByName(rules.length_issues(f))
    got = rules.issues(f)
    assert got.columns == both.columns and [x.dataType for x in got.schema] == [x.dataType for x in both.schema]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, both.collect())) and got.count() == 6
