"""Queries of this package that SQL can express, against DuckDB, and the registration of all."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from snapledger.llm import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_result(spark, name):
    assert compare(spark, connect(SF), SF, catalog.QUERIES[name], catalog.SQL[name]) is None


def test_every_operator_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op") and k.split("_")[0][2:].isdigit()}
    assert "pipeline" in names and set(catalog.SQL) <= set(entry.oracle_sql())
