"""Every registered query against its SQL, over whole tables of the smallest size."""

import pytest

from assetlake.workload.registry import oracle_sql, queries
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name)) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
