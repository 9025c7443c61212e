"""Every query with a SQL statement returns what DuckDB returns, to the last bit, and the rest return rows."""

import pytest
from checker import connect, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
# These fit dozens of models of full size, for minutes; the plans behind them are tested with small models.
LONG = {"grid_check", "search_check"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LONG))
def test_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 150
    assert rows.columns[0] == "customer_unique_id"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
