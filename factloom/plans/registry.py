"""Registered queries of the core engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: add a query under ``name`` with its SQL oracle, if there is one."""

    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if oracle:
            _ORACLES[name] = oracle
        return query

    return add


def queries() -> dict[str, Query]:
    from factloom.plans import core_queries  # noqa: F401  (registers on import)

    return _QUERIES


def oracles() -> dict[str, str]:
    queries()
    return _ORACLES
