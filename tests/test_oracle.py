"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WITH_SQL = sorted(oracle_sql())
WITHOUT_SQL = sorted(set(queries()) - set(oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, duck, name):
    assert differences(queries()[name](spark, FOLDER), duck, oracle_sql()[name]) == []


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_gives_rows(spark, name):
    df = queries()[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:3] == ["series_id", "datetime", "aqi"]
    assert df.count() == 951


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())
