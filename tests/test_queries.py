"""Every registered query on the smallest tables against its SQL, or for at least a row without one."""

import os

import pytest
from compare import compare, database

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    status, details, _ = compare(spark, con, FOLDER, name, entry.queries()[name], SQL.get(name))
    assert status in ("ok", "rows"), details


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
