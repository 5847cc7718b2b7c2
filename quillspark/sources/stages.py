"""Items in folders by stage: raw, normalized, reviewed, failed.

Records lie in ``stage=<name>`` folders. Moves that no transition allows are refused and given back; the others
rewrite the folders that they leave and enter, and no others. Only reviewed items go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.review import STAGES, TRANSITIONS
from . import shared

FIRST, LAST, FAILED = STAGES[0], "reviewed", "failed"


def _put(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(path)


def collect_items(items: DataFrame, path: str) -> None:
    """New items, all raw."""
    _put(items.withColumns({"reason": F.lit(None).cast("string"), "stage": F.lit(FIRST)}), path)


def read_items(spark: SparkSession, path: str, schema: T.StructType, stage: str | None = None) -> DataFrame:
    """Items (schema, reason, stage) of all stages or one."""
    full = T.StructType([*schema.fields, T.StructField("reason", T.StringType()), T.StructField("stage", T.StringType())])
    rows = spark.read.schema(full).parquet(path)
    return rows if stage is None else rows.filter(F.col("stage") == stage)


def allowed(before: Column, after: Column) -> Column:
    return F.concat_ws(">", before, after).isin(*(f"{a}>{b}" for a, b in TRANSITIONS))


def move_items(path: str, schema: T.StructType, key: str, moves: DataFrame) -> DataFrame:
    """Moves items (key, to, reason), one row an item. Gives back the refused ones (key, before, to): those
    that no transition allows and failures without a reason. Unknown items move nothing."""
    spark = moves.sparkSession
    rows = read_items(spark, path, schema)
    wanted = moves.select(F.col(key).alias("__key"), F.col("to").alias("__to"), F.nullif(F.trim("reason"), F.lit("")).alias("__reason"))
    good = allowed(F.col("stage"), F.col("__to")) & ((F.col("__to") != FAILED) | F.col("__reason").isNotNull())
    asked = shared.stored(rows.join(wanted, F.col(key) == F.col("__key")).select("__key", F.col("stage").alias("__before"), "__to", "__reason", F.coalesce(good, F.lit(False)).alias("__good")))
    done = asked.filter("__good")
    touched = {r[0] for c in ("__before", "__to") for r in done.select(c).distinct().collect()}  # four at most
    if touched:
        both = rows.filter(F.col("stage").isin(sorted(touched))).join(done.drop("__before", "__good"), F.col(key) == F.col("__key"), "left")
        moved = F.col("__to").isNotNull()
        fresh = both.withColumns({"reason": F.when(moved, F.col("__reason")).otherwise(F.col("reason")), "stage": F.coalesce("__to", "stage")})
        new = shared.stored(fresh.select(*rows.columns))
        left = {r[0] for r in new.select("stage").distinct().collect()}
        _put(new, path)
        for stage in touched - left:  # nothing is written for a stage that all items left
            shared.delete(spark, f"{path}/stage={stage}")
    return asked.filter("not __good").select(F.col("__key").alias(key), F.col("__before").alias("before"), F.col("__to").alias("to"))


def manifest_of(rows: DataFrame, key: str) -> DataFrame:
    """One row an item for its manifest: how far it has come."""
    return rows.select(
        F.col(key).cast("string").alias("collection_id"), F.lit("Y").alias("raw_collected"), F.when(F.col("stage").isin("normalized", LAST), "Y").otherwise("N").alias("normalized"),
        F.col("stage").alias("review_status"), F.coalesce("reason", F.lit("")).alias("note"),
    )
