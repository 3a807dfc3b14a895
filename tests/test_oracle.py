"""Every registered query runs on the small tables, and matches its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tidemark.queries import COVERS
from tools.check import compare, oracle_connection


@pytest.fixture(scope="module")
def con(sf):
    return oracle_connection(sf)


@pytest.mark.parametrize("name", sorted(COVERS))
def test_query(spark, sf, con, name):
    ok, message = compare(spark, con, sf, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_every_query_says_what_it_covers():
    assert set(COVERS) <= set(entry.queries())
    assert all(COVERS.values())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "accuracy"]
    assert df.count() > 0
