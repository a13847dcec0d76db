"""Issues of touched functions: one join, and rows are made distinct once."""

from lodestack.operators import hunks
from lodestack.plans import catalogue_changes


def test_functions_meet_changes_once(spark):
    plan = catalogue_changes.touched_issues(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1 and plan.count("Aggregate") == 1


def test_meetings_repeat_or_not(spark):
    functions = spark.createDataFrame([("r", "a", "f", 1, 200)], "repo_id string, file_path string, name string, start_line int, end_line int")
    patch = "@@ -1 +60,10 @@\n" + "+x\n" * 10
    changes = spark.createDataFrame([("r", "c", "a", patch), ("r", "d", "a", patch)], "repo_id string, commit string, path string, patch string")
    assert sorted(r["commit"] for r in hunks.touched_functions(functions, changes).collect()) == ["c", "d"]
    often = hunks.touched_functions(functions, changes, once=False)
    assert often.count() == 4 and often.distinct().count() == 2  # two bins each
