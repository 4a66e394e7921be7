"""Every registered query with SQL must agree with DuckDB on the smallest scale factor."""

from __future__ import annotations

import os

import pytest
from conftest import SF

from checks.catalogue import ORACLES, QUERIES
from checks.compare import check, oracle_connection

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    problem, _ = check(spark, con, SF, name)
    assert problem is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 5
    assert df.columns[0] == "population"
