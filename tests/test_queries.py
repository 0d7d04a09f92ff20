"""Every registered query against its SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, name):
    _, _, problem = compare(spark, connection, SF, name, entry.queries()[name], SQL.get(name))
    assert not problem


def test_entry_and_keys(spark):
    df = entry.entry(spark)
    assert df.columns == ["file_id", "part_no", "text", "cue_count"] and df.count() > 0
    assert not set(SQL) - set(entry.queries())
