"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.compare import compare, database
from webtables.catalog import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, problem = compare(spark, con, QUERIES[name], ORACLE.get(name), SF)
    assert problem is None
