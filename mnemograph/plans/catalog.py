"""All registered queries of the library outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "bm25_topk"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with its SQL where SQL can express it."""

    def add(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


from . import benchmark_queries, dynamics_queries, experiment_queries, graph_queries, source_queries, store_queries, text_queries, world_queries  # noqa: E402, F401
