"""The daily roll-up of answers as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import daily_with_confidence, merge_daily
from ..sources import shared


def daily_stream(events: DataFrame, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Answers and right answers by user and day over a stream of events; rows up to ``late``
    behind the newest still count, state of older days is dropped."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return (
        timed.groupBy(F.window("__ts", "1 day").alias("w"), "user_id")
        .agg(F.count("*").alias("solved"), F.count_if(F.col("event_type") != "error").alias("correct"))
        .select("user_id", F.to_date("w.start").alias("day"), "solved", "correct")
    )


DAY = "day date, solved long, correct long, confidence map<string, long>, batch long"


def merge_batch(path: str, answers: DataFrame, batch: int) -> None:
    """Adds the answers (ts, correct, level) of one batch to the stored days: solved, correct and counts by
    level. A day remembers the last batch that it took, so a batch that comes again, whole or after
    it was written in part, counts once. Only the days of the batch are read and written."""
    spark = answers.sparkSession
    new = daily_with_confidence(answers, F.to_date("ts"), F.col("correct"), F.col("level"))
    new = shared.stored(new)
    days = [r["day"] for r in new.select("day").distinct().collect()]  # of one batch
    if not days:
        return
    old = stored_days(spark, path).filter(F.col("day").isin(days))
    fresh = new.join(old.filter(F.col("batch") >= batch).select("day"), "day", "left_anti")
    both = merge_daily(old.filter(F.col("batch") < batch), fresh, "day").join(fresh.select("day"), "day", "left_semi")
    merged = shared.stored(both.withColumn("batch", F.lit(batch).cast("long")))
    merged.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    """(day, solved, correct, confidence, batch) of the days so far."""
    if not shared.exists(spark, path):
        return spark.createDataFrame([], DAY)
    return spark.read.schema(DAY).parquet(path)


def merge_stream(answers: DataFrame, path: str, checkpoint: str):
    """Takes a stream of answers that is there now into the stored days, and ends; started again with the same
    checkpoint it goes on where it was."""
    run = answers.writeStream.foreachBatch(lambda rows, batch: merge_batch(path, rows, batch)).option("checkpointLocation", checkpoint)
    return run.trigger(availableNow=True).start()
