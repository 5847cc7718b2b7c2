"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, released, slices, spare, stored, vocabulary, with_end
from .library import library, memory

WINDOW = 2048
GROUP_WINDOWS = 128  # windows that are balanced together
CUT = 512  # a document's rest is cut into pieces of at most this many ids
STEP_BYTES = 1 << 20  # of texts that go to the library at a time, as pieces are known from one step to the next

PIECES = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


# ---- differencing ---------------------------------------------------------------
def karmarkar_karp(sizes: list[int], ways: int) -> list[list[int]]:
    """Splits items into so many sets of nearly equal sums; gives item numbers by set.

    Each item starts as a partial partition of its own. The two with the largest
    imbalance are merged with opposing order, the largest set of one with the smallest
    of the other, until one partition is left.
    """
    left = list(range(len(sizes))) + [0] * len(sizes) * 2
    right = [-1] * len(left)
    left = np.array(left, np.int64)
    right = np.array(right, np.int64)
    used = len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        sums, node = np.zeros(ways, np.int64), np.full(ways, -1, np.int64)
        sums[0], node[0] = s, i
        heap.append((-s, i, sums, node))
    heapq.heapify(heap)
    order = itertools.count(len(sizes))
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heapq.heappop(heap)
        s, o = s1 + s2[::-1], n2[::-1]  # s1 descends, s2 reversed ascends
        both = (n1 >= 0) & (o >= 0)
        node = np.where(n1 >= 0, n1, o)
        k = int(both.sum())
        if used + k > len(left):
            left, right = (np.concatenate([x, np.full(len(x) + k, -1, np.int64)]) for x in (left, right))
        left[used : used + k], right[used : used + k] = n1[both], o[both]
        node[both] = np.arange(used, used + k)
        used += k
        by = np.argsort(-s, kind="stable")
        s, node = s[by], node[by]
        heapq.heappush(heap, (int(s[-1] - s[0]), next(order), s - s[-1], node))
    out = []
    for root in heap[0][3].tolist() if heap else []:
        items, todo = [], [root] if root >= 0 else []
        while todo:
            x = todo.pop()
            if x < len(sizes):
                items.append(x)
            else:
                todo += [int(left[x]), int(right[x])]
        out.append(sorted(items))
    return out


def windows_of(sizes: list[int], window: int) -> list[list[int]]:
    """Near-equal windows, as few as hold all: the count rises while one is too full."""
    ways = max(1, -(-sum(sizes) // window))
    step = 1
    while True:
        sets = karmarkar_karp(sizes, ways)
        if all(sum(sizes[i] for i in s) <= window for s in sets):
            return [s for s in sets if s]
        ways, step = ways + step, step + max(1, ways // 64)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` ids.

    A document is its ids and then ``end_id``; null text counts as empty (its only id is
    ``end_id``). Full windows of a document are sequences of their own; what is left
    is cut into pieces of at most CUT ids, and about GROUP_WINDOWS windows of pieces
    are balanced together by Karmarkar-Karp differencing. One row for each piece:
    the id column, start (ids of the document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id (unique) and offset (gapless from 0).
    A task balances what it reads, one group at a time; what is too little for a group is
    passed on and balanced with that of other tasks, so that the padding doesn't depend on
    the partitioning. Repeated rows are packed each; null ids pass through; an empty table
    gives none; other columns are dropped.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *PIECES.fields, T.StructField(spare("loose", [id_col]), T.BooleanType())])
    loose = schema.fields[-1].name
    docs = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(spare("text", [id_col])))

    def run(batches):
        out = Sequences(schema, window, 0)
        for whole in batches:
            for b in slices(whole, whole.schema.names[1], step=STEP_BYTES):
                ids = with_end(library(path)(b.column(1), *memory(path)), end_id)
                blob, starts = ids.values.tobytes(), (ids.starts * 4).tolist()
                for doc, lo, hi in zip(b.column(0).to_pylist(), starts, starts[1:], strict=False):
                    out.add(doc, blob[lo:hi])
                yield out.flush(b.schema.field(0).type)
        if out.rest:
            out.pass_on()
            yield out.flush(b.schema.field(0).type)

    def again(batches):
        out = Sequences(schema, window, 1)
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                out.hold(*row)
            yield out.flush(b.schema.field(0).type)
        if out.rest:
            out.balance()
            yield out.flush(b.schema.field(0).type)

    first = stored(docs.mapInArrow(released(run), schema))
    left = first.filter(loose)
    tokens = left.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-tokens // (GROUP_WINDOWS * window * 16)))  # sixteen groups a task
    both = first.filter(~F.col(loose)).unionByName(left.repartition(parts).mapInArrow(released(again), schema))
    return both.drop(loose)


class Sequences:
    """Pieces of documents as rows, and those that wait for their group."""

    def __init__(self, schema: T.StructType, window: int, turn: int):
        self.schema, self.window = schema, window
        self.numbers = itertools.count((2 * TaskContext.get().partitionId() + turn) << 33)
        self.rows: list[tuple] = []
        self.rest: list[tuple] = []  # (id, start, ids, doc_tokens)
        self.waiting = 0

    def add(self, doc, ids: bytes) -> None:
        """A document: its full windows, and pieces of what is left."""
        total = len(ids) // 4
        full = total - total % self.window
        for start in range(0, full, self.window):
            self.rows.append((doc, start, self.window, ids[start * 4 : (start + self.window) * 4], total, next(self.numbers), 0, False))
        for start in range(full, total, CUT):
            self.hold(doc, start, ids[start * 4 : (start + CUT) * 4], total)

    def hold(self, doc, start: int, ids: bytes, total: int) -> None:
        self.rest.append((doc, start, ids, total))
        self.waiting += len(ids) // 4
        if self.waiting >= GROUP_WINDOWS * self.window:
            self.balance()

    def balance(self) -> None:
        for items in windows_of([len(r[2]) // 4 for r in self.rest], self.window):
            number, at = next(self.numbers), 0
            for i in items:
                doc, start, ids, total = self.rest[i]
                self.rows.append((doc, start, len(ids) // 4, ids, total, number, at, False))
                at += len(ids) // 4
        self.rest, self.waiting = [], 0

    def pass_on(self) -> None:
        """What waits is for another task to balance."""
        self.rows += ((doc, start, len(ids) // 4, ids, total, None, None, True) for doc, start, ids, total in self.rest)
        self.rest, self.waiting = [], 0

    def flush(self, id_type: pa.DataType) -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=self.schema.names)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
