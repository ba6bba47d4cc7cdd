"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as spark_entry
from oracle import connect, differences

QUERIES = spark_entry.queries()
SQL = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def con(medium):
    return connect(medium)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, medium, con, name):
    assert differences(QUERIES[name](spark, medium), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_gives_rows(spark, medium, name):
    assert not QUERIES[name](spark, medium).isEmpty()


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 6


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
