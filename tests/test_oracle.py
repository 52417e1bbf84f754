"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from msgrisk.plans.queries import QUERIES

NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, sf_dir, name):
    assert compare(spark, connection, sf_dir, name) is None


def test_each_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())
    assert set(NAMES) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r["tier"] for r in rows} <= {"none", "notice", "alert"}
