"""Registry of the queries run on the driver's tables.

Each query is a function ``(spark, sf_dir) -> DataFrame`` over whole tables,
optionally with an equivalent SQL string for an independent engine
(tables pre-registered as views under their own names).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from hearth.plans import (  # noqa: F401
        q_relational, q_features, q_threshold, q_neighbors, q_models, q_clusters, q_io)
