"""Lists of records that are stored and edited: only the buckets that an edit touches are written.

A list lies in ``bucket=<hash of the key>`` folders. An edit reads the buckets of its keys, makes
their new rows, stores these in the shared folder and then puts them in place of the old ones (dynamic partition overwrite), so
until the last step the list is as it was. All edits give the same list if they are done again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

BUCKETS = 32


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _put(rows: DataFrame, path: str) -> None:
    placed = rows.repartition("bucket").sortWithinPartitions("bucket")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_list(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A new list in place of whatever is at the path."""
    shared.delete(rows.sparkSession, path)
    _put(rows.withColumn("bucket", _bucket(key, buckets)), path)


def read_list(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All records; none where there is no list."""
    nothing = spark.createDataFrame([], schema)
    if not shared.exists(spark, path):
        return nothing
    return spark.read.schema(schema).parquet(path).select(nothing.columns)


def edit(path: str, schema: T.StructType, key: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> int:
    """Replaces the buckets that hold the keys (a column named ``key``) by ``change`` of their rows, and gives the number of
    buckets. At most ``buckets`` numbers reach the driver."""
    spark = keys.sparkSession
    touched = sorted(r[0] for r in keys.select(_bucket(key, buckets)).distinct().collect())
    if not touched:
        return 0
    placed = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    old = read_list(spark, path, placed).filter(F.col("bucket").isin(touched)).drop("bucket")
    new = shared.stored(change(old).withColumn("bucket", _bucket(key, buckets)))
    left = {r[0] for r in new.select("bucket").distinct().collect()}
    _put(new, path)
    for bucket in set(touched) - left:  # nothing is written for a bucket without rows
        shared.delete(spark, f"{path}/bucket={bucket}")
    return len(touched)


def insert_if_absent(path: str, new: DataFrame, key: str, buckets: int = BUCKETS) -> int:
    """Adds records whose key isn't there."""
    return edit(path, new.schema, key, new, lambda old: old.unionByName(new.join(old.select(key), key, "left_anti")), buckets)


def upsert(path: str, changes: DataFrame, key: str, schema: T.StructType, stamp: str, now: Column, buckets: int = BUCKETS) -> int:
    """Records with the changed columns of ``changes`` (one row a key) and a stamp; keys that aren't there change nothing."""
    from ..operators.review import update_rows

    return edit(path, schema, key, changes, lambda old: update_rows(old, changes, key, stamp, now), buckets)


def remove(path: str, keys: DataFrame, key: str, schema: T.StructType, buckets: int = BUCKETS) -> int:
    return edit(path, schema, key, keys, lambda old: old.join(keys.select(key), key, "left_anti"), buckets)


def append_capped(path: str, new: DataFrame, owner: str, order: list[Column], most: int, buckets: int = BUCKETS) -> int:
    """Adds records and keeps the first ``most`` of each owner in an order; lists are by owner. A record
    that is there already, column by column, isn't added again."""
    from ..operators.relational import cap_newest

    return edit(path, new.schema, owner, new, lambda old: cap_newest(old.unionByName(new).distinct(), owner, order, most), buckets)


def read_blobs(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines by a schema, and apart from these the lines that it doesn't fit."""
    lines = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    lines = shared.stored(lines)  # both sides of one reading
    return lines.filter("_bad is null").drop("_bad"), lines.filter("_bad is not null").select(F.col("_bad").alias("line"))
