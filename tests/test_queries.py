"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import pytest

from mnemoria.plans import catalog
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    query, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql is None:
        assert query(spark, FOLDER).count() >= 0
    else:
        assert compare(spark, con, name, query, sql, FOLDER) == ""


def test_entry_module(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
