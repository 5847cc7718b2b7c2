"""Token-id files: independent zstandard frames with a seek table at the end.

A file holds consecutive documents, one frame each (the ids as little-endian unsigned
32-bit integers, the frame with its own content checksum), and then two skippable
frames:

* the directory: the documents' ids, as JSON in a zstandard frame of its own;
* the seek table: for each frame its compressed size, its decompressed size and the
  low 32 bits of the xxh64 of its content; then the number of frames, a descriptor
  byte and the magic number.

A reader takes the seek table from the end of the file and then reads and
decompresses only the frames of the documents asked for.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, shared_folder, slices, spare, vocabulary, with_end
from .library import library

# --- fixed values: numbers of the seekable zstandard format -----------------------
SKIPPABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
HAS_CHECKSUM = 0x80

DIRECTORY = 0x184D2A50  # skippable frame that holds the directory
ENTRY = np.dtype([("stored", "<u4"), ("size", "<u4"), ("check", "<u4")])
ROWS = 512  # documents that a reader unpacks at a time
FILES = 1024  # files whose starts are summed in one group


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


class FrameWriter:
    """Writes one file of frames; under its final name only once it is complete."""

    def __init__(self, uri: str, attempt: str):
        self.fs, self.path = _open(uri)
        self.part = f"{self.path}.{attempt}"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.zip = zstandard.ZstdCompressor(level=1, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list = []

    def add(self, doc, ids: bytes) -> None:
        frame = self.zip.compress(ids)
        self.out.write(frame)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.docs.append(doc)

    def close(self) -> None:
        directory = self.zip.compress(json.dumps(self.docs).encode())
        self.out.write(struct.pack("<II", DIRECTORY, len(directory)) + directory)
        table = np.array(self.entries, ENTRY).tobytes()
        foot = struct.pack("<IBI", len(self.entries), HAS_CHECKSUM, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot)
        self.out.close()
        self.fs.move(self.part, self.path)  # a repeated attempt puts the same bytes there


class FrameReader:
    """Reads documents of one file by their position or their id."""

    def __init__(self, uri: str):
        filesystem, path = _open(uri)
        self.file = filesystem.open_input_file(path)
        end = self.file.size()
        self.file.seek(end - 9)
        count, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"no seek table in {uri}")
        start = end - 9 - count * ENTRY.itemsize
        self.file.seek(start)
        self.entries = np.frombuffer(self.file.read(count * ENTRY.itemsize), ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["stored"], dtype=np.int64)])
        self.unzip = zstandard.ZstdDecompressor()
        self.file.seek(int(self.offsets[-1]))
        _, size = struct.unpack("<II", self.file.read(8))
        self.docs = json.loads(self.unzip.decompress(self.file.read(size)))

    def read(self, at: int) -> bytes:
        """The ids of the document at a position; its frame alone is decompressed."""
        self.file.seek(int(self.offsets[at]))
        entry = self.entries[at]
        ids = self.unzip.decompress(self.file.read(int(entry["stored"])), max_output_size=int(entry["size"])) if entry["size"] else b""
        if len(ids) != entry["size"] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {at} is damaged")
        return ids

    def find(self, doc) -> Iterator[bytes]:
        """The ids of every document with this id."""
        return (self.read(i) for i, d in enumerate(self.docs) if d == doc)


def write_token_files(df: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents, each with ``end_id`` at its end, in ascending
    order of their id; gives the manifest: one row a file, in the order of ``file``.

    Null texts count as empty (only ``end_id``); null ids come first; rows of equal id
    are ordered by text, repeated rows stay; an empty table writes no file; other columns are
    ignored. Range partitioning by id (and how the text begins, so that one id may fill
    several files) deals the rows out; only those are sampled for it, never whole texts. A file takes its final name only when complete, so a task may be repeated at any
    time. Files belong to the caller.
    """
    id_type = df.schema[id_col].dataType
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text, mark = spare("text", [id_col]), spare("begins", [id_col])
    ordered = (
        df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text), F.coalesce(F.substring(text_col, 1, 24), F.lit("")).alias(mark))
        .repartitionByRange(parts, id_col, mark)
        .sortWithinPartitions(id_col, text)
        .drop(mark)
    )
    schema = T.StructType(
        [T.StructField("file", T.StringType()), T.StructField("first_id", id_type), T.StructField("docs", T.LongType()), T.StructField("ids", T.LongType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri = f"{folder}/{task.partitionId():08d}.tok"
        out, total, kind = None, 0, None
        for whole in batches:
            for b in slices(whole, whole.schema.names[1]):
                kind = b.schema.field(0).type
                out = out or FrameWriter(uri, f"{task.taskAttemptId()}.{os.getpid()}")
                ids = with_end(library(path)(b.column(1)), end_id)
                blob, starts = ids.values.tobytes(), (ids.starts * 4).tolist()
                for doc, lo, hi in zip(b.column(0).to_pylist(), starts, starts[1:], strict=False):
                    out.add(doc, blob[lo:hi])
                total += len(ids.values)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array(out.docs[:1], kind), pa.array([len(out.docs)]), pa.array([total])], names=schema.names
            )

    manifest = f"{folder}/manifest"
    ordered.mapInArrow(run, schema).write.parquet(manifest)
    return df.sparkSession.read.schema(schema).parquet(manifest)


def read_token_files(manifest: DataFrame, id_col: str = "doc_id", docs: list | None = None) -> DataFrame:
    """The documents in the files of a manifest: id, start (ids of all documents
    before it, in the order of the files), n_tokens and ids (little-endian unsigned
    32-bit). With ``docs``, frames of other documents are neither read nor unpacked. An
    empty manifest gives none; rows of equal id all come.

    Starts are summed over the files of each group of FILES, and the groups' sums (a row for
    so many files) before them."""
    numbered = manifest.withColumn("group", F.floor(F.regexp_extract("file", r"([0-9]+)\.tok$", 1).cast("long") / FILES))
    sums = numbered.groupBy("group").agg(F.sum("ids").alias("sum"))
    ahead = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("group", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum("ids").over(Window.partitionBy("group").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = numbered.withColumn("within", within).join(bases, "group").select("file", "first_id", (F.col("ahead") + F.col("within")).alias("base"), "docs")
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = manifest.schema["first_id"].dataType
    schema = T.StructType(
        [T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    wanted = None if docs is None else set(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.schema.field(1).type
            for uri, base in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                file = FrameReader(uri)
                starts = base + np.concatenate([[0], np.cumsum(file.entries["size"] // 4, dtype=np.int64)])
                order = (i for i, d in enumerate(file.docs) if wanted is None or d in wanted)
                while at := list(itertools.islice(order, ROWS)):
                    ids = [file.read(i) for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file.docs[i] for i in at], kind),
                            pa.array(starts[at]),
                            pa.array([len(x) // 4 for x in ids], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        names=schema.names,
                    )

    return files.repartition(parts, "file").mapInArrow(run, schema)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), 2, shared_folder(spark))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
