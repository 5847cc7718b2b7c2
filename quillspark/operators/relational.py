"""Relational reads: keyword search, relevance, top-k, grouped text, ranks, edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any_case


def any_contains(columns: Sequence[Column], needle: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | contains_any_case(c, needle)
    return out


def search(rows: DataFrame, keywords: DataFrame, on: str, columns: Sequence[str], keyword: str, query: str) -> DataFrame:
    """Rows in which a column, or one of the row's keywords, contains the query.

    The same rows as a left join with the keywords, a filter on both sides and a
    deduplication, but without the fan-out: keywords that match become a semi join.
    """
    hits = keywords.filter(contains_any_case(F.col(keyword), query)).select(F.col(on).alias("__hit")).distinct()
    joined = rows.join(hits, F.col(on) == F.col("__hit"), "left")
    own = any_contains([F.col(c) for c in columns], query)
    return joined.filter(own | F.col("__hit").isNotNull()).drop("__hit")


def relevance(weights: Sequence[tuple[Column, int]]) -> Column:
    """Sum of the weights of the tests that hold; null tests add nothing."""
    total = F.lit(0)
    for test, weight in weights:
        total = total + F.when(test, weight).otherwise(0)
    return total


def newest_numbered(rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows of an order, numbered from 1: limited first, so that the unpartitioned
    window only sees ``limit`` rows."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_per_group(rows: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def grouped_text(rows: DataFrame, group: str, order: str, text: str, sep: str = " ") -> DataFrame:
    """The texts of each group joined in their order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), sep).alias(text))


# ---- edits of stored lists -----------------------------------------------------------------
def insert_new(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows, and the new ones whose key is not there yet."""
    return stored.unionByName(new.join(stored.select(key), key, "left_anti"))


def cap_newest(rows: DataFrame, owner: str, order: Sequence[Column], most: int) -> DataFrame:
    """The newest rows of each owner."""
    return top_per_group(rows, owner, order, most).drop("rank")


def set_memo(rows: DataFrame, key: str, value, column: str, memo: str | None) -> DataFrame:
    """Rows with the memo of one of them replaced; a blank memo becomes null."""
    fresh = F.nullif(F.trim(F.lit(memo or "")), F.lit(""))
    return rows.withColumn(column, F.when(F.col(key) == value, fresh).otherwise(F.col(column)))


def delete_by_id(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(~F.col(key).eqNullSafe(value))


# ---- constraints -----------------------------------------------------------------------------
def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).count().filter("count > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no parent (null references are no orphans)."""
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)).distinct(), column, "left_anti")
