"""Every query against its SQL; those without SQL must run."""

import pytest
from conftest import DATA, against_sql

from foliant.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    ours, theirs = against_sql(spark, QUERIES[name], SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
