"""Every registered query against its SQL twin on the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
