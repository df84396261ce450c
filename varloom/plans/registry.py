"""Named queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import driver_queries, variant_queries  # noqa: F401  the second adds its own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(driver_queries.Q)


def oracle_sql() -> dict[str, str]:
    return dict(driver_queries.SQL)
