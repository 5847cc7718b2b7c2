"""All queries of the library proper, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import legal, relational, storage, text

PLANS = (relational, text, legal, storage)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
