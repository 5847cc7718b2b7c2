"""Study history: daily roll-ups, calendar spine, streaks, accuracy, weak areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is 0 or nothing is there."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def daily_rollup(answers: DataFrame, day: Column, correct: Column, *by: str) -> DataFrame:
    """Answers and right answers of each day."""
    return answers.groupBy(*by, day.alias("day")).agg(F.count("*").alias("solved"), F.count_if(correct).alias("correct"))


def calendar(daily: DataFrame, first: Column, last: Column) -> DataFrame:
    """Every day from first to last; days without a row get zeros."""
    spine = daily.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    return spine.join(daily, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("solved", "correct")])


def streaks(days: DataFrame, owner: str, day: str, today: Column) -> DataFrame:
    """Length of the run of consecutive days that ends today or yesterday, by owner."""
    number = F.row_number().over(Window.partitionBy(owner).orderBy(day))
    islands = days.select(owner, day).distinct().withColumn("island", F.date_sub(day, number))
    runs = islands.groupBy(owner, "island").agg(F.count("*").alias("streak"), F.max(day).alias("last"))
    return runs.filter(F.col("last").between(F.date_sub(today, 1), today)).select(owner, "streak")


def last_days(daily: DataFrame, owner: str, days: int = 7) -> DataFrame:
    """Running sum over the last days, gaps included: a frame over day numbers."""
    frame = Window.partitionBy(owner).orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    return daily.withColumn("recent", F.sum("solved").over(frame))


def merge_counts(rows: DataFrame, counts: str, *by: str) -> DataFrame:
    """Sums of a map of counters over rows, one row for each key."""
    return rows.select(*by, F.explode(counts).alias("key", "n")).groupBy(*by, "key").agg(F.sum("n").alias("n"))


def subject_key(path: Column, parts: int = 2) -> Column:
    """The first parts of a path "a > b > c"; null for a blank one."""
    key = F.array_join(F.slice(F.split(path, " > "), 1, parts), " > ")
    return F.nullif(F.trim(key), F.lit(""))


def weak_subjects(answers: DataFrame, path: Column, k: int, least: int = 2, wrong: Column | None = None) -> DataFrame:
    """Subjects with the most stored answers, ``least`` at least. All answers count, right or
    wrong; with ``wrong`` only those for which it holds."""
    kept = answers if wrong is None else answers.filter(wrong)
    found = kept.select(subject_key(path).alias("subject")).filter("subject is not null").groupBy("subject").count()
    return found.filter(F.col("count") >= least).orderBy(F.desc("count"), "subject").limit(k)


def countdown(now: Column, target: Column) -> Column:
    """Whole days between the midnights of two moments."""
    return F.datediff(target, now)


def progress(solved: Column, goal: Column) -> Column:
    return F.least(F.lit(1.0), ratio(solved, goal))
