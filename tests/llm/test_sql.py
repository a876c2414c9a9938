"""Queries that SQL can express, on whole tables, and their plans."""

import pytest

from parchment.llm.queries import QUERIES, SQL
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert compare(spark, QUERIES[name], SQL[name]) > 0


@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_chat_formatting", "op5_sharding"])
def test_native(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
