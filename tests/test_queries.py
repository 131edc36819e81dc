"""Each registered query against its SQL twin."""

import os

import pytest

import __spark_entry__ as entry_point
from compare import connect, duck_rows, spark_rows
from sendledger.workload.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    names, rows = spark_rows(entry_point.queries()[name](spark, SF_DIR))
    expected_names, expected = duck_rows(con, entry_point.oracle_sql()[name])
    assert names == expected_names
    assert len(rows) == len(expected)
    assert rows == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
