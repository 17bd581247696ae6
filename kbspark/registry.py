"""All queries of the library outside the training-data subpackage, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query function under a name, with its DuckDB twin if it has one."""

    def add(query: Query) -> Query:
        _queries[name] = query
        if oracle is not None:
            _oracles[name] = oracle
        return query

    return add


def _load() -> None:
    from . import plans  # noqa: F401  registers the queries


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
