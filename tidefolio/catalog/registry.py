"""Query registration."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("panel", "series", "benchmark", "risk", "signals", "allocation", "limited", "performance", "jobs")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def register(fn: Query) -> Query:
        if fn.__name__ in _QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tidefolio.catalog.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
