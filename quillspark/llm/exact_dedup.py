"""Exact deduplication by distributed MSD radix partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, numbered, scratch, spare, stored

FIRST_DIGIT, GROWTH = 64, 16  # bytes of the first digit; each next digit is so many times wider


def normal_text(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(""))


def exact_dedup(df: DataFrame, id_col: str, text: Column, keep: list[str], number: str | None = None) -> DataFrame:
    """One row for each row of ``df``: the columns ``keep`` (``id_col`` among them), and
    keep_id (id of the row that stays), group_size (rows with an equal text) and kept.

    Rows are split by successive digits of their text's bytes: 64 bytes, then 1 KB,
    16 KB, ... A round counts each (group, digit) with a partial aggregation, so a
    group that holds a third of all rows leaves each task as one row. Groups of one
    row are done, groups whose texts have ended are equal, and only the rest goes
    on to the next digit. No digest decides; bytes do.

    Null texts count as empty; null ids come last (keep_id is null only if all of the
    group are); of rows that agree in both id and text the one of the smallest ``number``
    stays, a column of row numbers that are the same in every scan (without it, those of ``numbered``).
    Texts of any length are compared whole. An empty table gives none.
    Columns not in ``keep`` are dropped, so clashing names can't occur.
    """
    with scratch(df.sparkSession) as keep_table:
        if number is None:
            number = spare("at", df.columns)
            df = numbered(df, number)
        return keep_table(_split(df, id_col, text, keep, number))


def _split(df: DataFrame, id_col: str, text: Column, keep: list[str], number: str) -> DataFrame:
    row = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(number).alias("at"))
    todo = df.select(
        F.struct(*keep).alias("kept_columns"), row.alias("row"), F.lit(0).cast("long").alias("node"), F.encode(text, "utf-8").alias("rest")
    )
    done: DataFrame | None = None
    width, last = FIRST_DIGIT, None
    while True:
        todo = todo.withColumns({"digit": F.substring("rest", 1, width), "ended": F.octet_length("rest") <= width})
        groups = (
            todo.groupBy("node", "digit", "ended")
            .agg(F.count("*").alias("n"), F.min("row").alias("first"))
            .filter("n > 1")
            .withColumn("child", F.monotonically_increasing_id())
        )
        groups = stored(groups)
        split = todo.join(groups.hint("merge"), ["node", "digit", "ended"], "left")  # hot keys are split by adaptive execution
        own = F.col("n").isNull()
        out = split.filter(own | F.col("ended")).select(
            "kept_columns.*",
            F.when(own, F.col(f"row.{id_col}")).otherwise(F.col(f"first.{id_col}")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (own | (F.col("row") == F.col("first"))).alias("kept"),
        )
        done = out if done is None else done.unionAll(out)
        if groups.filter("not ended").isEmpty():
            return done
        todo = stored(
            split.filter("n > 1 and not ended").select("kept_columns", "row", F.col("child").alias("node"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        )
        width *= GROWTH


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", normal_text(F.col("text")).alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    return exact_dedup(docs, "doc_id", F.col("text"), ["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), '') AS x FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
        FROM t"""
}
