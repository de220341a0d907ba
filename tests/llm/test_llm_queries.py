"""Queries of this subpackage: against SQL where there is one, and recall where there isn't."""

import os

import pytest

from mnemoria.llm import catalog
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    query, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql is None:
        assert query(spark, FOLDER).count() > 0
    else:
        assert compare(spark, connect(FOLDER), name, query, sql, FOLDER) == ""
