"""Every registered query of the engine against its SQL."""

import pytest
from oracle import by_duckdb, by_spark

from waymark import plans

FOLDER = "/root/testdata/sf0.001"
plans.load()


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, name):
    got, want = by_spark(plans.QUERIES[name](spark, FOLDER)), by_duckdb(plans.SQL[name], FOLDER)
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0
