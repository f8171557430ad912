"""Registered queries, beside their SQL where there is one."""

import duckdb
import pytest

import __spark_entry__ as entry
from termpulse.llm import oracles, queries

NUMBERS = range(1, 14)


def test_all_operators_are_registered():
    names = list(queries.all_queries())
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(NUMBERS)
    assert set(names) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", oracles.oracle_sql())
def test_sql(name, spark, sf):
    got = queries.all_queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(oracles.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = [sorted(map(str, r)) for r in (map(tuple, got.select(order).collect()), want.select(", ".join(order)).fetchall())]
    assert rows[0] == rows[1]
