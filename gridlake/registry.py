"""Queries over the driver's tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlake.plans import grid_queries, more_queries, stored_queries, value_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (grid_queries, value_queries, more_queries, stored_queries)


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
