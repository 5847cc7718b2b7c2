"""A stored index of character triples: substring search that reads only the triples asked for.

    postings/bucket=<b>   gram, doc, field     once for each text of the document's field, sorted by gram
    counts/bucket=<b>     gram, n
    texts                 doc, field, text     sorted by doc, or as they are read

A text that contains a string has all of its triples, so the rarest of these, intersected by document and
field, leave few candidates, whose texts are then looked at. Case is ignored throughout. Strings of
fewer than three characters have no triple and are looked for in all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_any_case, let
from .inverted import bucket_of

SIZE = 3
INTERSECTED = 4  # triples of a string that are intersected, the rarest; the texts decide


@dataclass(frozen=True)
class Grams:
    spark: SparkSession
    path: str
    buckets: int
    doc_type: str

    def read(self, part: str) -> DataFrame:
        columns = {"postings": f"gram string, doc {self.doc_type}, field string, bucket int", "counts": "gram string, n long, bucket int", "texts": f"doc {self.doc_type}, field string, text string"}
        return self.spark.read.schema(columns[part]).parquet(f"{self.path}/{part}")

    def of(self, part: str, grams: list[str], buckets: list[int]) -> DataFrame:
        return self.read(part).filter(F.col("bucket").isin(sorted(set(buckets))) & F.col("gram").isin(sorted(grams)))


def grams(text: Column) -> Column:
    """The distinct triples of a text in lower case."""

    def of(letters: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(letters) - SIZE)
        return F.when(F.size(letters) >= SIZE, F.array_distinct(F.transform(starts, lambda i: F.concat(*(F.get(letters, i + k) for k in range(SIZE))))))

    return let(F.split(F.lower(text), "", -1), of)


def _dealt(found: Column, buckets: int) -> Column:
    """(bucket, run) of distinct triples: those of a bucket as one string, one after the other, since each has ``SIZE``
    characters. What is shuffled are the triples and a bucket's head, not a row for each triple."""
    pairs = F.sort_array(F.transform(found, lambda g: F.struct(bucket_of(g, buckets).alias("bucket"), g.alias("gram"))))

    def of(rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda x, j: F.struct(x["bucket"].alias("bucket"), j.alias("j"))), lambda x: (x["j"] == 0) | (F.get(rows, x["j"] - 1)["bucket"] != x["bucket"]))
        size = lambda s, x, k: F.coalesce(F.get(s, k + 1)["j"], F.size(rows)) - x["j"]
        joined = lambda s, x, k: F.array_join(F.transform(F.slice(rows, x["j"] + 1, size(s, x, k)), lambda r: r["gram"]), "")
        return let(starts, lambda s: F.transform(s, lambda x, k: F.struct(x["bucket"].alias("bucket"), joined(s, x, k).alias("run"))))

    return let(pairs, of)


def write(path: str, rows: DataFrame, doc: str, field: str, text: str, buckets: int = 64, unique: bool = False) -> Grams:
    """Writes the index of (doc, field, text); a document may have several texts of one field. Null
    texts contain nothing, and null documents are left out. ``unique``: texts of one document and field are
    mostly one, so that equal ones needn't be brought together; those that do repeat are kept and change no result."""
    index = Grams(rows.sparkSession, path, buckets, rows.schema[doc].dataType.simpleString())
    known = rows.filter(F.col(doc).isNotNull() & F.col(text).isNotNull())
    texts = known.select(F.col(doc).alias("doc"), F.col(field).alias("field"), F.col(text).alias("text"))
    texts = texts if unique else texts.distinct().hint("rebalance", "doc").sortWithinPartitions("doc", "field")
    texts.write.parquet(f"{path}/texts")
    dealt = index.read("texts").select("doc", "field", F.inline(_dealt(grams(F.col("text")), buckets))).hint("rebalance", "bucket")
    places = F.sequence(F.lit(1), F.length("run"), F.lit(SIZE))
    placed = dealt.select("doc", "field", "bucket", F.explode(F.transform(places, lambda i: F.substring(F.col("run"), i, F.lit(SIZE)))).alias("gram"))
    placed.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    counted = index.read("postings").groupBy("bucket", "gram").agg(F.count("*").alias("n")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
    counted.write.partitionBy("bucket").parquet(f"{path}/counts")
    return index


def candidates(index: Grams, needle: str, fields: list[str] | None = None) -> DataFrame | None:
    """(doc, field) of the texts that have the needle's rarest triples; none if it has no triple."""
    wanted = index.spark.range(1).select(F.explode(grams(F.lit(needle))).alias("gram")).select("gram", bucket_of(F.col("gram"), index.buckets).alias("bucket")).collect()
    if not wanted:
        return None
    asked, buckets = [r["gram"] for r in wanted], [r["bucket"] for r in wanted]
    counts = {r["gram"]: r["n"] for r in index.of("counts", asked, buckets).select("gram", "n").collect()}  # those of one string
    rarest = sorted(wanted, key=lambda r: (counts.get(r["gram"], 0), r["gram"]))[:INTERSECTED]
    postings = index.of("postings", [r["gram"] for r in rarest], [r["bucket"] for r in rarest])
    if fields is not None:
        postings = postings.filter(F.col("field").isin(fields))
    return postings.groupBy("doc", "field").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(rarest)).select("doc", "field")


def containing(index: Grams, needle: str, fields: list[str] | None = None) -> DataFrame:
    """(doc, field) of the texts that contain the needle, whatever the case."""
    texts, found = index.read("texts"), candidates(index, needle, fields)
    if fields is not None:
        texts = texts.filter(F.col("field").isin(fields))
    if found is not None:
        texts = texts.join(found, ["doc", "field"], "left_semi")
    return texts.filter(contains_any_case(F.col("text"), needle)).select("doc", "field").distinct()


def long_rows(rows: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    """(doc, field, text) of some columns."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))
    return rows.select(F.col(doc).alias("doc"), F.inline(pairs))
