"""Every registered query against its SQL twin."""
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    assert not compare(spark, con, SF, name).startswith("FAIL")


def test_entry(spark):
    assert entry(spark).count() == 12
    assert set(oracle_sql()) <= set(queries())
