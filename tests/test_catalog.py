"""Every registered station query against its SQL, and the rows of those that SQL cannot express."""

import pytest
from oracle import assert_equal, connect

import __spark_entry__ as entry
from fluvia.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in catalog.ORACLES:
        assert_equal(df, con, catalog.ORACLES[name])
    else:
        assert df.count() > 0 or name in ("temporal_regimes",)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark):
    """Column pruning reaches the files."""
    plan = entry.queries()["station_year_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in plan and "o_orderdate" in plan
