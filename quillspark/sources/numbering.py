"""Line numbers of text files that are read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

BROADCAST_SPLITS = 100_000  # rows of the table of splits up to which it is broadcast


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of every line, numbered from 1 within each file.

    Lines are stored once with their split and their place in the reading task, which is in
    order within a split. Splits are counted, the counts of a file added up in the order of the splits,
    and each line gets the lines before its split and its place in it. Only the table of splits is
    ever sorted or moved.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    lines = stored(read)
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")
    splits = stored(splits.select("file", "start", "first", before.alias("before")))
    few = splits.count() <= BROADCAST_SPLITS
    placed = lines.join(F.broadcast(splits) if few else splits, ["file", "start"])
    return placed.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")
