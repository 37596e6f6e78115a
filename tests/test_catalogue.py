"""Registered queries against their SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry_point
from compare import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()
SELECTED = sorted(ORACLES)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 20


@pytest.mark.parametrize("name", SELECTED)
def test_equal_to_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), duck, ORACLES[name]) == []
