"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    problem = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None or (problem == "no rows" and name in ("live_projects",)), problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
