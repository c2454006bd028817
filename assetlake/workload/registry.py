"""Registered queries: a Spark function and, where SQL can say it, the same query for a SQL engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assetlake.session import tune
from assetlake.workload.views import Tables, with_views

Query = Callable[[Tables], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = with_views(sql)
        return fn

    return add


def _bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Tables(tune(spark), folder))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def load() -> None:
    """Import every module that registers queries."""
    from assetlake.workload import (  # noqa: F401
        aggregate_queries, duplicate_queries, filter_queries, join_queries, plan_queries, scalar_queries,
        source_queries, stream_queries, task_queries, window_queries,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: _bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)
