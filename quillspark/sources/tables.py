"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def published(spark: SparkSession, rows: DataFrame, status: str = "status", name: str = "published_cases") -> DataFrame:
    """The view of published rows; its predicate merges with those of queries over it."""
    view = rows.filter(f"{status} = 'published'")
    view.createOrReplaceTempView(name)
    return view
