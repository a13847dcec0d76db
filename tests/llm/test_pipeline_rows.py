"""Each stage of the pipeline by itself, on nothing and on rows that hold nothing but nulls."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a``b` int, kept string"
NULLS = [(1, None, None, None, None, None, None), (None, None, None, None, None, None, None)]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([("i1", "one two three"), ("i2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, sf_dir, name):
    out = STAGES[name](spark, spark.createDataFrame([], SCHEMA), sf_dir)
    assert out.count() == 0 and (name == "packing" or out.columns == corpus_pipeline.COLUMNS)


@pytest.mark.parametrize("name", STAGES)
def test_rows_of_nulls(spark, sf_dir, name):
    rows = STAGES[name](spark, spark.createDataFrame(NULLS, SCHEMA), sf_dir).collect()
    ids = sorted((r["doc_id"] for r in rows), key=repr)
    assert ids == ([1, None] if name in ("simhash_near_dedup", "packing") else [])
    if name == "packing":
        assert [r["length"] for r in rows] == [1, 1]
