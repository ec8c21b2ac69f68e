"""Every registered query against its DuckDB statement on the smallest tables."""

import pytest
from check import compare, duck
from conftest import SMALL

import __spark_entry__ as entry_points

QUERIES = entry_points.analytics()
ORACLES = {name: sql for name, sql in entry_points.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, ORACLES[name]) == ""


def test_every_analytics_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 115
