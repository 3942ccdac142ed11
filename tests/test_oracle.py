"""Every registered query against its DuckDB equivalent on the smallest tables."""

import pytest

from snapledger.plans.catalog import QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = {name: q.sql for name, q in QUERIES.items() if q.sql is not None}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_equivalent():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_result(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name].build, SQL[name]) is None
