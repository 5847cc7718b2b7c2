"""Byte-level BPE encoding and decoding, and token counts."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import documents, list_array, map_texts, slices, vocabulary, with_columns


def _shipped(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary for all tasks: its size doesn't depend on the input."""
    return df.sparkSession.sparkContext.broadcast(bpe.Merger.from_file(path))


def encode_bpe(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the token ids (array<int>) of each whole text; null counts as empty.

    Every match of the split pattern is encoded separately by the ranks, without
    special tokens: rows of padded matrices merge their leftmost minimum-rank pair
    each round.  Empty texts give an empty array, very long ones all of their ids;
    repeated rows stay; an empty table gives none; other columns pass through, one
    named ``ids_col`` is replaced.
    """
    merger = _shipped(df, path)

    def make():
        pattern = bpe.split_pattern()
        return lambda texts: [list_array(bpe.encode_texts(texts, merger.value, pattern))]

    return map_texts(df, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], make)


def decode_bpe(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds the bytes of each row's ids; null or empty ids give empty bytes.  Repeated rows
    stay; an empty table gives none; other columns pass through, one named ``bytes_col``
    is replaced."""
    schema = with_columns(df.schema, [T.StructField(bytes_col, T.BinaryType())])
    names = [f.name for f in schema.fields[:-1]]
    merger = _shipped(df, path)

    def run(batches):
        for whole in batches:
            for b in slices(whole, ids_col, 4):
                ids = b.column(ids_col)
                counts = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                rows = bpe.Ragged.of(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                made = merger.value.decode(rows)
                sizes = made.starts.astype(np.int32)  # a slice is far below 2 GB
                column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(made.values.tobytes())])
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), column], names=[*names, bytes_col])

    return df.mapInArrow(run, schema)


# ---- counts ------------------------------------------------------------------
def single_tokens(merger: bpe.Merger, pattern) -> frozenset[str]:
    """The vocabulary strings that are one match of the split pattern and that the
    merges turn into exactly one token: proven by encoding each of them."""
    texts = []
    for raw in merger.token_bytes:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if text and pattern.fullmatch(text) and pattern.findall(text) == [text]:
            texts.append(text)
    return frozenset(t for t, n in zip(texts, merger.encode(pa.array(texts)).counts.tolist(), strict=True) if n == 1)


def special_strings(path: str) -> list[str]:
    """The strings inside texts that the library takes as one special token each."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", [])]


def specials(path: str) -> regex.Pattern | None:
    found = sorted(special_strings(path), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, found))) if found else None


def count_tokens(df: DataFrame, path: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each whole text, as the library for ``path``
    counts them: special strings inside texts are one token; null counts as empty
    (0).  Pre-tokens proven to be one token are counted directly, only the rest is
    merged; the proof is made once, by the driver.  Repeated rows stay; an empty table
    gives none; other columns pass through, one named ``count_col`` is replaced.
    """
    merger = bpe.Merger.from_file(path)
    special = specials(path)
    known = pa.array(sorted(single_tokens(merger, bpe.split_pattern()) | set(special_strings(path))), pa.string())
    shared = df.sparkSession.sparkContext.broadcast((merger, known))  # as large as the vocabulary

    def make():
        pattern = bpe.split_pattern()
        merger, known = shared.value

        def run(texts):
            rows, found = bpe.pieces(texts, pattern, special)
            pieces = bpe.strings_of(found)
            size = np.ones(len(pieces), np.int64)
            rest = pa.compute.invert(pa.compute.is_in(pieces, known))
            size[rest.to_numpy(zero_copy_only=False)] = merger.encode(pieces.filter(rest)).counts
            return [pa.array(rows.sums(found.table.sums(size)))]

        return run

    return map_texts(df, text_col, [T.StructField(count_col, T.LongType())], make)


# ---- queries -----------------------------------------------------------------
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ids = encode_bpe(documents(spark, sf_dir).select("doc_id", "text"), path).drop("text")
    digest = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))
    both = decode_bpe(digest, path)
    return both.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = count_tokens(docs, vocabulary("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
    )
