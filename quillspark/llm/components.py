"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, stored

ROW_BYTES = 48  # of a row of two numbers in a broadcast table


def _canonical(links: DataFrame) -> DataFrame:
    """Distinct links (hi, lo) with hi > lo."""
    return links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct()


def _moved(df: DataFrame, col: str, to: DataFrame) -> DataFrame:
    """The column with each number replaced by where it was contracted to."""
    step = to.select(F.col("hi").alias("__from"), F.col("to").alias("__to"))
    joined = join_small(df.withColumn("__from", F.col(col)), step, ["__from"], "left", ROW_BYTES)
    return joined.withColumn(col, F.coalesce("__to", col)).drop("__from", "__to")


def _total(to: DataFrame):
    return to.agg(F.sum(F.col("to").cast("decimal(38,0)"))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every number that occurs in a link (a, b) and isn't the smallest
    of its component; root is that smallest number.

    Each round, every number with a smaller neighbour is contracted into the smallest
    one (an aggregation with map-side combining, so hubs are no hot spots), chains of
    such moves are followed by doubling, and only links between different roots go on.
    Every table is written to the shared folder, which cuts lineage.  Repeated and
    reversed links and links of a number with itself change nothing; no links give no rows.
    """
    links = stored(_canonical(links))
    labels: DataFrame | None = None
    while not links.isEmpty():
        to = stored(links.groupBy("hi").agg(F.min("lo").alias("to")))
        while True:
            further = stored(_moved(to, "to", to))
            same = _total(further) == _total(to)  # moves only go down
            to = further
            if same:
                break
        if labels is None:
            labels = to
        else:
            labels = stored(_moved(labels, "to", to).unionByName(to))  # only roots so far are in ``to``
        links = stored(_canonical(_moved(_moved(links, "hi", to), "lo", to).select(F.col("hi").alias("a"), F.col("lo").alias("b"))))
    if labels is None:
        return links.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    return labels.select(F.col("hi").alias("id"), F.col("to").alias("root"))
