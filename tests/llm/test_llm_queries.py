"""The queries of the subpackage on the smallest tables, against SQL where there is some."""

import glob
import os

import pytest

from mnemospark.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name]).df()
        assert sorted(map(tuple, got[sorted(got.columns)].astype(str).values)) == sorted(map(tuple, want[sorted(want.columns)].astype(str).values))
    if name == "p3_recall":
        assert (got["recall"] >= 0.9).all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_found_rows_come_through_the_operators(spark):
    packed = plan(queries.p6_found(spark, SF))
    assert packed.count("Window [") >= 2 and "container(" in packed  # ranks, offsets and the container of each item
    mixed = plan(queries.p7_found(spark, SF))
    assert "upto" in mixed and "copies" in mixed and "Window [" in mixed  # the seeded selection
