"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pytest

from lodestack.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _normal(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query_equals_sql(spark, con, name):
    want = con.sql(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert _normal(map(tuple, got.select(*want.columns).collect())) == _normal(want.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
