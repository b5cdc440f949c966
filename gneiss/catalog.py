"""All queries of the library outside the corpus operators, gathered from their modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    """Add a query under its operator's name, with the SQL that gives the same rows where there is one."""
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _load() -> None:
    from gneiss import workloads

    workloads.load()


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
