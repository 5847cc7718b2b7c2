"""Lines that many documents share go from all of them but one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_small, scratch, stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW_BYTES = 64  # of a key or a line's place in a broadcast table


def line_key(line: Column) -> Column:
    """What lines are compared by: no white space at the ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashes(*values: Column) -> list[Column]:
    """128 bits: of 10^12 different values, two agree with a chance below 10^-14."""
    return [F.xxhash64(*values), F.xxhash64(F.lit("other"), *values)]


def drop_repeated_lines(df: DataFrame, id_col: str, text_col: str, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of ``df`` with n_lines, n_dropped and kept_text: the text without lines whose
    key has ``min_chars`` code points or more and is found in ``min_docs`` documents or more,
    but with those in the document of the largest id that has them.

    Lines are exploded and hashed. A first count takes every hash of a long line (partially
    aggregated, so a line that is everywhere leaves each task as one row); lines whose
    hash was counted often enough meet their hash again, and only of these the
    distinct documents are counted. The places of lines to drop go back to the documents, which are put together again
    by position; texts move once, and not at all if there are few places.

    Documents are told apart by id; a null id is one more document, never the largest.
    Rows that agree in id and text lose the same lines. Null texts count as empty; an
    empty text is one empty line; texts of any length are taken whole; an empty table gives none.
    ``df`` must be deterministic, since it is read three times. Columns named like an added one are dropped.
    """
    with scratch(df.sparkSession) as keep:
        return _without_repeats(df, id_col, text_col, min_chars, min_docs, keep)


def _without_repeats(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    own = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    d1, d2 = _hashes(F.col(id_col), text)
    rows = df.select(F.struct(*own).alias("own"), F.col(id_col).alias("id"), text.alias("text"), d1.alias("d1"), d2.alias("d2"))

    lines = rows.select("id", "d1", "d2", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.select("id", "d1", "d2", "at", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    h1, h2 = _hashes(F.col("key"))
    lines = lines.select("id", "d1", "d2", "at", h1.alias("h1"), h2.alias("h2"))

    often = stored(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2"))
    hits = stored(join_small(lines, often, ["h1", "h2"], "inner", ROW_BYTES))
    held = hits.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    shared = stored(held.filter(F.col("n") >= min_docs).select("h1", "h2", "last"))
    gone = join_small(hits, shared, ["h1", "h2"], "inner", ROW_BYTES).filter(~F.col("id").eqNullSafe(F.col("last")))
    places = keep(gone.groupBy("d1", "d2").agg(F.collect_set("at").alias("gone")))

    back = join_small(rows, places, ["d1", "d2"], "left", ROW_BYTES + 4 * F.size("gone"))
    back = back.withColumn("lines", F.split("text", "\n", -1)).withColumn("n_lines", F.size("lines").cast("long"))
    staying = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(staying, lambda at: F.get(F.col("lines"), at)), "\n")
    return back.select(
        "own.*", "n_lines", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = {
    "op12_line_dedup": r"""
        WITH docs AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), l AS (
            SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs
        ), k AS (
            SELECT doc_id, place, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ), c AS (
            SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), m AS (
            SELECT doc_id, place, line, coalesce(doc_id <> last, false) AS gone FROM k LEFT JOIN c USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id"""
}
