"""A corpus pipeline: five operators in turn, from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of docs.

Null texts and texts without a letter go in the first stage; null ids come last where the
smallest id stays; of rows that agree in id and text one stays; an empty table gives an empty one;
columns beside doc_id, text, lang pass through, whatever their names. Rows are numbered by their
place in their file, however it is split; docs that are no files are stored first.

Every stage lets the session send texts to Python in batches of BATCH_ROWS rows, or fewer if it is set so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, language, ngram_join, packing, pii
from quillspark.llm.common import BATCH, drop_stored, join_small, numbered, scratch, spare, stored, vocabulary


BATCH_ROWS = 1000  # rows of an Arrow batch: some megabytes of texts in the executor and in its Python workers


def _short_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a number that is the same in every scan, and the name of that column."""
    name = spare("row_number", docs.columns)
    return numbered(docs, name), name


def _without(rows: DataFrame, gone: DataFrame, number: str) -> DataFrame:
    """The rows whose number is not among the dropped ones."""
    return join_small(rows, gone, [number], "left_anti", 24).drop(number)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; those without a letter go."""
    _short_batches(spark)
    model = language.fitted(docs)
    added = {"lang_pred", "score", "accepted"}
    names = {c: spare(f"own_{c}", docs.columns) for c in docs.columns if c.lower() in added}  # step aside for what is added
    found = language.identify(docs.withColumnsRenamed(names), model).filter("accepted")
    return found.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of smallest doc_id."""
    _short_batches(spark)
    rows, number = _numbered(docs)
    with scratch(spark) as keep:
        found = exact_dedup.exact_dedup(rows, "doc_id", exact_dedup.normal_text(F.col("text")), ["doc_id", number], number)
        gone = keep(found.filter("not kept").select(number))
    return _without(rows, gone, number)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by five-word shingles at a similarity
    of 0.8 or more: the one of smallest doc_id."""
    _short_batches(spark)
    rows, number = _numbered(docs)
    with scratch(spark) as keep:
        found = ngram_join.ngram_groups(rows, "doc_id", n=5, percent=80, number=number)
        gone = keep(found.filter("not stays").select(F.col("row").alias(number)))
    return _without(rows, gone, number)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind."""
    _short_batches(spark)
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    _short_batches(spark)
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # SQL cannot express the language model or the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each gives is written to the shared folder and read
    again, so no stage is computed twice and lost executors cost one stage at most."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            drop_stored(before)  # a stage's input goes once its output is there
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
