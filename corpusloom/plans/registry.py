"""Registry of named queries: Spark callable ``(spark, sf_dir) -> DataFrame`` plus,
where the result is SQL-expressible, its DuckDB oracle.

Each query module registers with ``@query(name, sql=...)``; the SQL text is
assembled from the shared fixture CTEs of ``sql_fixtures`` by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from corpusloom.plans import (embedding_queries, graph_queries, keyphrase_queries,  # noqa: F401
                                  metric_queries, ml_queries, sampling_queries, scoring_queries,
                                  source_queries, text_queries)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
