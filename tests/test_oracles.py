"""Every registered job with SQL against DuckDB on the smallest tables."""

import os

import oracle_check
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
JOBS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle_check.duck(SF)


def test_every_sql_has_a_job():
    assert set(SQL) <= set(JOBS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", sorted(SQL))
def test_job_equals_sql(spark, connection, name):
    assert oracle_check.compare(spark, connection, SF, JOBS[name], SQL[name]) is None
