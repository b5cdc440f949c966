"""Corpus queries that have SQL give the same rows as that SQL in DuckDB."""

import duckdb
import pytest

from gneiss.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    df = registry.queries()[name](spark, sf)
    ran = con.execute(SQL[name])
    columns = [d[0] for d in ran.description]
    expected = sorted(ran.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(columns).collect()) == expected
