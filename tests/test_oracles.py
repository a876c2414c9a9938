"""Every query that has SQL gives what DuckDB gives; every other one runs."""

import pytest

from parchment.catalog import FLAGSHIP, QUERIES, SQL
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 20
