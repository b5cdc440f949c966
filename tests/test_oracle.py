"""Every query that has SQL gives the same rows as that SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from gneiss import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    ran = duck.execute(SQL[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, ran.fetchall())
