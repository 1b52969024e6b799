"""Every registered query against its SQL twin, in a session zone that is not UTC."""

import importlib

import pytest

from catalog.compare import connect, differences
from catalog.oracle import ORACLE
from catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert differences(df, con, ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
