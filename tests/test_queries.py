"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from queryset.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    oracles = entry.oracle_sql()
    query = entry.queries()[name]
    if name not in oracles:
        assert query(spark, SF).count() > 0
        return
    problem = compare(spark, con, SF, query, oracles[name])
    assert problem == "", problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 5
