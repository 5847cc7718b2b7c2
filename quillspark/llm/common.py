"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Ragged

STEP_BYTES = 16 << 20  # of texts that one step of a task works on, if there is more than one


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir (or what setCheckpointDir has set), which
    driver and executors share. Where neither is set, a local session (as in tests) gets
    a local one; a cluster is refused, since each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:/tmp/checkpoints"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    return path


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())  # folders written inside each open scratch() of a thread


def stored(df: DataFrame) -> DataFrame:
    """Writes a table in the shared folder and reads it again: cuts lineage, and what is
    read back survives the loss of executors. Inside ``scratch`` the table goes when the
    block ends, by ``drop_stored`` at once; else when the driver ends."""
    path = shared_folder(df.sparkSession)
    with _short_batches(df.sparkSession):
        df.write.parquet(path)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000  # rows that a step's Python functions get at a time: texts of some megabytes on both sides


_writing: list[str] = []  # the session's own setting, once for each step that is being stored
_lock = threading.Lock()


@contextlib.contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, rows go to Python in batches of BATCH_ROWS, unless the session has shorter ones."""
    with _lock:
        own = _writing[0] if _writing else spark.conf.get(BATCH)
        _writing.append(own)
        if not 0 < int(own) <= BATCH_ROWS:
            spark.conf.set(BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        with _lock:
            own = _writing.pop()
            if not _writing:
                spark.conf.set(BATCH, own)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a stored table that is no longer needed."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Inside, tables may be stored freely; at the end all are deleted but those that
    ``keep`` has written, so that only results take room."""
    outer, written, kept = _scopes.get(), [], []
    token = _scopes.set((*outer, written))

    def keep(df: DataFrame) -> DataFrame:
        out = stored(df)
        kept.append(written.pop())
        return out

    try:
        yield keep
    finally:
        _scopes.reset(token)
        for folder in written:
            _delete(spark, folder)
        if outer:
            outer[-1].extend(kept)


def with_columns(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    """Schema with the fields at its end; columns of the same name give way."""
    taken = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in taken] + fields)


def spare(name: str, taken: list[str]) -> str:
    """A column name near ``name`` that none of the taken ones equals."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, scale: int = 1, step: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values in a column (of strings, or of lists of ``scale`` bytes
    an element) take about ``step`` bytes (STEP_BYTES), or one row."""
    values = batch.column(batch.schema.get_field_index(column))
    measure = pc.binary_length if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length
    ends = np.cumsum(pc.fill_null(measure(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64) * scale
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + (step or STEP_BYTES), "right")))
        yield batch.slice(at, to - at)
        at = to


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives freed memory back to the system at its end: workers live on."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return whole


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list]],
    step: int | None = None,
) -> DataFrame:
    """Adds columns computed from whole texts, some megabytes of them (``step`` bytes) at a time.

    ``make`` runs once in a task and returns the function from an Arrow array of texts
    (null: empty) to one Arrow array or list for each field; what it holds goes with the
    task. All other columns pass through.
    """
    schema = with_columns(df.schema, fields)
    names = [f.name for f in schema.fields[: len(schema.fields) - len(fields)]]
    types = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for b in slices(whole, text_col, step=step):
                texts = pc.fill_null(b.column(text_col), "")
                made = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(f(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *made], names=schema.names)
                del texts, made

    return df.mapInArrow(released(run), schema)


def list_array(rows: Ragged) -> pa.ListArray:
    """Rows of numbers as an Arrow array of lists."""
    if rows.starts[-1] > np.iinfo(np.int32).max:
        raise OverflowError("too many values for one Arrow batch")
    return pa.ListArray.from_arrays(pa.array(rows.starts.astype(np.int32)), pa.array(rows.values))


def with_end(ids: Ragged, end_id: int) -> Ragged:
    """Rows of ids as little-endian unsigned 32-bit integers, each with ``end_id`` at its end."""
    return Ragged(np.insert(ids.values.astype("<u4"), ids.starts[1:], end_id), ids.starts + np.arange(len(ids.starts)))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def bounded_sample(df: DataFrame, columns: list[str], key: Column, rows: int) -> list[Row]:
    """At most ``rows`` rows, those whose key hashes lowest, and of equal hashes any: a bounded
    sample that doesn't depend on the partitioning. Only hashes are compared at first, about
    twice as many as rows, whatever the size of the table; then only the chosen rows are sent."""
    taken = spare("hash", df.columns)
    hashed = df.withColumn(taken, F.xxhash64(key))
    total = hashed.count()
    share = 2.0 * rows / max(total, 1)
    while True:
        below = hashed if share >= 1 else hashed.filter(F.col(taken) < F.lit(int(-(2**63) + share * 2**64)))
        counts = [(r[0], r[1]) for r in below.groupBy(taken).count().orderBy(taken).limit(rows).collect()]
        if share >= 1 or sum(n for _, n in counts) >= rows:
            break
        share *= 4  # some keys have many rows
    last, found = None, 0
    for last, n in counts:
        found += n
        if found >= rows:
            break
    if last is None:
        return []
    chosen = hashed.filter(F.col(taken) <= last).select(*columns, F.col(taken).alias(taken)).limit(rows).collect()
    return sorted(chosen, key=lambda r: (r[-1], repr(r)))


MOST_FILES = 500_000  # whose hashes and places are broadcast, some 16 MB; tables of more files are stored with numbers


def _is_scan(df: DataFrame) -> bool:
    """Whether rows come from files one by one, only columns and rows being chosen."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.relation().fileFormat().toString().lower().startswith("parquet")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds a number of its own to each row, the same whenever and in whatever splits the table is read:
    the place of its file among the files, by a hash of the path, and its place in the file. What is no
    scan of Parquet files is stored first, with its numbers."""
    if _is_scan(df):
        found = df.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path")).distinct()
        files = sorted(r["file"] for r in found.select("file").limit(MOST_FILES + 1).collect())
        if len(files) <= MOST_FILES and len(set(files)) == len(files):
            file, place = spare("file", [*df.columns, name]), spare("place", [*df.columns, name])
            places = df.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), f"{file} long, {place} long")
            rows = df.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(name))
            rows = rows.join(F.broadcast(places), file)
            return rows.select(*[F.col(c) for c in df.columns], (F.shiftleft(place, 40) + F.col(name)).alias(name))
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


SMALL_BYTES = 16 << 20  # a side up to this measured size is broadcast; beyond it, a shuffle join


def join_small(big: DataFrame, side: DataFrame, on: list[str], how: str, row_bytes: Column | int) -> DataFrame:
    """Joins a stored side: broadcast if its measured size allows it, else by shuffle
    (where adaptive execution splits hot keys of the big side)."""
    size = side.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return big.join(F.broadcast(side) if size <= SMALL_BYTES else side.hint("merge"), on, how)
