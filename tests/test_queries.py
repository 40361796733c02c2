"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from rowscrub.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER) is None


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) <= set(entry.queries()) & set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "body", "additional_info", "year", "country_code"] and df.count() > 0


def test_head_takes_as_many_rows_as_before(spark):
    """5000 rows, or all of a table of fewer."""
    assert catalogue.head_rows(spark, FOLDER).count() == min(5000, spark.read.parquet(f"{FOLDER}/documents.parquet").count()) > 100
