"""The queries of the core operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The modules that register queries.
MODULES = ("core", "retrieval", "content", "knowledge", "activity")


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the equivalent SQL if there is one."""

    def keep(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return keep


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"memlode.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
