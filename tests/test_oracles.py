"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catalog import oracles, queries
from catalog.check import compare, oracle_connection

QUERIES = queries.all_queries()
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle_connection(sf)


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_result(spark, con, sf, name):
    assert compare(spark, con, sf, name, QUERIES[name], SQL[name]) is None
    spark.catalog.clearCache()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "rank", "word", "word_count", "total_count", "avg_score", "sentiment",
        "positive_ratio", "negative_ratio",
    ]
    assert df.count() == 20
