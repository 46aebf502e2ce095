"""Queries that SQL can state, against DuckDB on whole small tables."""

import duckdb
import pytest

from captionlake.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        c.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), c.sql(queries.ORACLE_SQL[name])
    order = lambda columns, rows: sorted(repr([r[columns.index(x)] for x in sorted(columns)]) for r in rows)
    assert sorted(got.columns) == sorted(want.columns)
    assert order(got.columns, [tuple(r) for r in got.collect()]) == order(want.columns, want.fetchall())
