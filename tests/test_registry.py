"""Every registered query against its SQL on the smallest data set."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry_point
from dirgauge.plans import oracle, registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["path", "subtree_bytes", "subtree_count"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, SQL[name]) == ""
