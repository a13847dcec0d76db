"""A source's tokens are looked for once, and contents are not carried where numbers do."""

from lodestack.operators import goparse, gosyntax
from lodestack.plans import analysis

SOURCE = 'package p\n\nimport "fmt"\n\n// Run runs.\nfunc Run(a int) error {\n\tif a > 0 && a < 9 {\n\t\treturn nil\n\t}\n\treturn fmt.Errorf(`x\ny`)\n}\n\nfunc b%d() {}\n'


class _Never:
    def finditer(self, *_):
        raise AssertionError("tokens are looked for again")


def test_tokens_are_looked_for_once(monkeypatch):
    s = goparse.Source(SOURCE % 1)
    want = [(s.tokens[a], s.line_of(a), s.line_of(b - 1), name) for a, b, name in goparse.function_ranges(s)]
    monkeypatch.setattr(goparse, "TOKEN", _Never())
    found = goparse.parse(SOURCE % 1)
    assert [("func", f["start_line"], f["end_line"], f["name"]) for f in found["functions"]] == want == [("func", 6, 12, "Run"), ("func", 14, 14, "b1")]
    assert [(f["complexity"], f["comments"]) for f in found["functions"]] == [(3, "Run runs.\n"), (1, "")]
    assert goparse.parse("﻿" + SOURCE % 1)["error"] == "no package clause"


def test_known_declarations_change_no_fault():
    for _ in range(2):
        assert goparse.parse(SOURCE % 2)["error"] is None
        assert goparse.parse((SOURCE % 2) + "func c( {\n")["error"].startswith("line 15: ")
        assert goparse.parse((SOURCE % 2).replace("b2()", "b2(,)"))["error"].startswith("line 14: ")
    assert tuple("func name ( ) { } ;".split()) in gosyntax._well_formed


def test_contents_do_not_meet_the_unparseable(spark):
    files = spark.createDataFrame([("r", f"f{k}.go", SOURCE % k + "func (" * (k % 3 == 0)) for k in range(9)], "repo_id string, path string, content string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        tables = analysis.analyse(files)
        plan = tables["file_metrics"]._jdf.queryExecution().optimizedPlan().toString()
        for join in [line for line in plan.split("\n") if "Join" in line]:
            assert "LeftAnti" not in join
        assert sorted(r.path for r in tables["file_metrics"].collect()) == [f"f{k}.go" for k in range(9) if k % 3]
        assert [(r.file_count, r.function_count) for r in tables["totals"].collect()] == [(6, 12)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
