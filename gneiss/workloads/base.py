"""How workload modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from gneiss.catalog import register
from gneiss.sources.tables import CHAPTERS_SQL, EXPENSES_SQL, PROJECTS_SQL, Tables

VIEWS = f"WITH {EXPENSES_SQL}, {PROJECTS_SQL}, {CHAPTERS_SQL} "


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register ``fn(tables)`` under its own name, or another, with its SQL."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        register(name or fn.__name__, lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql)
        return fn

    return wrap
