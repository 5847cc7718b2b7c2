"""File sources and sinks: JSON lines, XML, manifests, JSON lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import numbered_lines

SAMPLE = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
POSTS = "_Id long, _PostTypeId int, _ParentId long, _Title string, _Body string"
MANIFEST = (
    "collection_id string, priority string, subject string, case_number string, case_name string, source_type string, source_url string, "
    "raw_collected string, meta_entered string, normalized string, review_status string, owner string, updated_at string, note string"
)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an id and a text: blank lines are skipped, a missing id becomes
    row-{line}, a missing text is an error that names the line, counted within its file."""
    lines = numbered_lines(spark, path)
    parsed = lines.filter(F.trim("line") != "").select("line_no", F.from_json("line", SAMPLE).alias("row"))
    bad = F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": text is missing"))).cast("string")
    return parsed.select(
        F.coalesce("row.id", F.concat(F.lit("row-"), F.col("line_no").cast("string"))).alias("id"),
        F.when(F.col("row.text").isNull(), bad).otherwise(F.col("row.text")).alias("text"),
    )


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, characters unescaped, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an XML dump with their attributes as columns."""
    rows = spark.read.format("xml").option("rowTag", "row").schema(POSTS).load(path)
    return rows.select(*[F.col(c).alias(c[1:]) for c in rows.columns])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a collection; quotes inside quoted fields are doubled."""
    return spark.read.option("header", True).option("escape", '"').schema(MANIFEST).csv(path)


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON list of objects in snake case as columns in camel case; an empty table where
    there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException:
        rows = spark.createDataFrame([], schema)
    camel = lambda name: name.split("_")[0] + "".join(p.capitalize() for p in name.split("_")[1:])
    return rows.select(*[F.col(c).alias(camel(c)) for c in rows.columns])


def concat_corpora(*parts: DataFrame) -> DataFrame:
    """All rows, each with the number of its source; nothing is deduplicated."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("source_no", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
