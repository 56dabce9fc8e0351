"""Every registered query on the smallest tables, beside its SQL where there is one."""

from pathlib import Path

import pytest
from oracle import connect, difference, spark_rows, sql_rows

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = spark_rows(entry.queries()[name](spark, SF_DIR))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1], "no rows"
    else:
        assert difference(got, sql_rows(con, sql)) is None
