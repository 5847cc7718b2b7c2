"""Nearest neighbours: anisotropic four-bit product quantisation and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, stored, with_columns

CENTRES = 16  # four bits
SAMPLE_ROWS = 8192  # bound of the sample that the code books are fitted on
ETA = 4.0  # weight of the residual parallel to the vector against the rest of it
CHUNK = 4096  # vectors scanned together
QUERIES = 16  # queries scanned together
RERANK = 128  # candidates of a chunk that are measured first, for each query
KNOWN = 1024  # vectors of the sample that tell how far the nearest can be
BLOCK_BYTES = 64 << 20  # of the queries that one pass over the index serves


class Codebooks:
    """Centres (subspace x 16 x dims) fitted so that the residual parallel to a vector,
    which is what changes inner products with queries near it, weighs ETA times more."""

    def __init__(self, sample: np.ndarray, sub: int = 2, rounds: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.sub = sub
        self.known = sample[:KNOWN]
        self.dims = sample.shape[1] if len(sample) else 0
        x = self.split(sample)  # rows x subspaces x sub
        n, m, _ = x.shape
        self.centres = np.zeros((m, CENTRES, sub))
        for j in range(m):
            self.centres[j] = x[rng.choice(n, CENTRES, replace=n < CENTRES), j] if n else 0
        for turn in range(rounds if n else 0):
            codes = self.encode(sample, sweeps=0 if turn < 4 else 1)
            self._refit(x, codes)

    def split(self, x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % self.sub
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), (x.shape[1] + pad) // self.sub, self.sub)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x subspaces): nearest centres, then coordinate descent on the
        anisotropic loss |r|^2 + (ETA-1) (r.u)^2, with r the residual, u the direction."""
        parts = self.split(x)
        n, m, _ = parts.shape
        u = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        c = self.centres
        # |r_j|^2 and r_j.u_j of every choice
        square = ((parts[:, :, None, :] - c[None]) ** 2).sum(-1)
        along = np.einsum("njd,njkd->njk", u, parts[:, :, None, :] - c[None])
        codes = square.argmin(-1)
        rows = np.arange(n)
        total = along[rows[:, None], np.arange(m), codes].sum(1)
        for _ in range(sweeps):
            for j in range(m):
                rest = total - along[rows, j, codes[:, j]]
                loss = square[:, j] + (ETA - 1) * (rest[:, None] + along[:, j]) ** 2
                codes[:, j] = loss.argmin(-1)
                total = rest + along[rows, j, codes[:, j]]
        return codes.astype(np.uint8)

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        n, m, d = x.shape
        norm = np.maximum(np.sqrt((x**2).sum((1, 2))), 1e-30)
        u = x / norm[:, None, None]
        rows = np.arange(n)
        for j in range(m):
            inner = np.stack([(self.centres[i][codes[:, i]] * u[:, i]).sum(1) for i in range(m)], 1).sum(1)
            inner -= (self.centres[j][codes[:, j]] * u[:, j]).sum(1)
            want = norm - inner  # what this subspace should add along u
            outer = np.eye(d)[None] + (ETA - 1) * u[:, j, :, None] * u[:, j, None, :]
            right = x[:, j] + (ETA - 1) * u[:, j] * want[:, None]
            for k in range(CENTRES):
                mine = rows[codes[:, j] == k]
                if len(mine):
                    self.centres[j, k] = np.linalg.solve(outer[mine].sum(0), right[mine].sum(0))
                else:
                    self.centres[j, k] = x[(j * 31 + k * 7) % n, j]

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return (even[:, ::2] << 4 | even[:, 1::2]).astype(np.uint8)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """The centres that packed codes stand for: rows x subspaces x sub."""
        codes = np.stack([packed >> 4, packed & 15], -1).reshape(len(packed), -1)[:, : len(self.centres)]
        return self.centres[np.arange(len(self.centres)), codes]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with two centres at once: queries x bytes x 256."""
        one = np.einsum("qjd,jkd->qjk", self.split(queries), self.centres)
        if one.shape[1] % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), -1, 256)


def usable(df: DataFrame, vec_col: str, id_col: str = "vec_id") -> DataFrame:
    """Rows that take part: id and vector not null, the vector not zero, with finite
    components only and as long as most of those are (of equally many, the longest)."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vec_col, lambda x: x != 0))
    length = good.groupBy(F.size(vec_col).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return good.filter(F.size(vec_col) == (length[0] if length else 0))


def fit(df: DataFrame, vec_col: str, rows: int = SAMPLE_ROWS) -> Codebooks:
    """Code books of the rows whose vector hashes lowest, at most ``rows``; of no rows, empty
    ones."""
    found = bounded_sample(df, [vec_col], F.col(vec_col), rows)
    return Codebooks(np.array([r[0] for r in found], np.float64).reshape(len(found), len(found[0][0]) if found else 0))


def build_index(df: DataFrame, books: Codebooks, vec_col: str, code_col: str = "code") -> DataFrame:
    """Adds every row's packed four-bit codes; repeated rows stay, an empty table gives none,
    all other columns pass through, one named ``code_col`` is replaced."""
    schema = with_columns(df.schema, [T.StructField(code_col, T.BinaryType())])
    shared = df.sparkSession.sparkContext.broadcast(books)  # 16 x dimensions numbers and some vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, CHUNK):
                b = whole.slice(k, CHUNK)
                packed = shared.value.pack(shared.value.encode(_matrix(b.column(vec_col))))
                codes = pa.array([r.tobytes() for r in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-1]), codes], names=schema.names)

    return df.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(index: DataFrame, queries: DataFrame, books: Codebooks, id_col: str, vec_col: str, k: int = 10, code_col: str = "code", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` nearest rows of each query by Euclidean distance, its own row left out:
    query_id, rank, vec_id, score; ties go to the smaller id.

    The index stays where it is stored; only queries move, in blocks of at most
    ``block_bytes``, each scanned by one pass over the index. Of equal vectors only the k + 1
    smallest ids can be near any query, so no more are scanned. A scan of code tables gives
    the distance of query and quantised vector; less the vector's own distance to its
    quantised form it is never above the true one. Rows whose bound is above the k-th distance
    known so far (at first from the sample of the code books) are out; the RERANK
    likeliest of the others are measured on the vectors themselves, which lowers that distance,
    and then what is still in. So the result is that of brute force, and only ``k`` rows a
    query leave a task. Empty tables give none; of queries of equal id the one of
    least vector is searched.
    """
    spark = index.sparkSession
    rows = index.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vector"), F.col(code_col).alias("code"))
    copies = Window.partitionBy("vector").orderBy("vec_id")
    rows = stored(rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"))
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("query")).groupBy("query_id").agg(F.min("query").alias("query"))
    size = asked.agg(F.sum(F.size("query") * 8 + 32 * k + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        part = mine.sort("query_id").collect()  # a block: at most about block_bytes
        ids = np.array([r[0] for r in part], np.int64)
        vectors = np.array([r[1] for r in part], np.float64).reshape(len(part), books.dims)
        shared = spark.sparkContext.broadcast((books, ids, vectors))
        scanned = rows.mapInArrow(_scanner(shared, k), "query_id long, vec_id long, score double")
        found = scanned if found is None else found.unionAll(scanned)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scanner(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, ids, vectors = shared.value
        if not len(ids):
            return
        scan = Scan(books, ids, vectors, k)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                scan.add(b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1)), codes)
        yield scan.found()

    return run


class Scan:
    """The nearest rows so far of each query of a block."""

    def __init__(self, books: Codebooks, ids: np.ndarray, queries: np.ndarray, k: int):
        self.books, self.ids, self.queries, self.k = books, ids, queries, k
        self.distance = np.full((len(ids), k), np.inf)
        self.nearest = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.radius = np.full(len(ids), np.inf)  # at least the k-th distance of the whole table
        if len(books.known) > k:
            for i, q in enumerate(queries):  # one more, as the query itself may be among them
                self.radius[i] = np.partition(_distances(books.known, q), k)[k]
        self.measured = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray) -> None:
        decoded = self.books.decode(codes)
        far = np.sqrt(((self.books.split(vectors) - decoded) ** 2).sum((1, 2)))  # of each vector from its quantised form
        square = (decoded**2).sum((1, 2))
        for lo in range(0, len(self.ids), QUERIES):
            q = self.queries[lo : lo + QUERIES]
            tables = self.books.tables(q)
            inner = np.zeros((len(q), len(ids)))
            for j in range(codes.shape[1]):
                inner += tables[:, j, codes[:, j]]
            sums = (q**2).sum(1)[:, None] + square
            # a little less than the bound, for the rounding of the sums
            lower = np.sqrt(np.maximum(sums * (1 - 1e-12) - 2 * inner, 0)) - far * (1 + 1e-9) - 1e-9 * np.sqrt(sums)
            lower[ids == self.ids[lo : lo + QUERIES, None]] = np.inf
            inside = (lower <= self.radius[lo : lo + QUERIES, None]) & (lower < np.inf)
            for i in np.flatnonzero(inside.any(axis=1)).tolist():
                self._measure(lo + i, np.flatnonzero(inside[i]), lower[i], ids, vectors)

    def _measure(self, i: int, rows: np.ndarray, lower: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Measures the likeliest rows, and then those that their distances don't exclude."""
        rows = rows[np.argsort(lower[rows], kind="stable")]
        for part in (rows[:RERANK], rows[RERANK:]):
            part = part[lower[part] <= self.radius[i]]
            if not len(part):
                return
            self.measured += len(part)
            d = np.concatenate([self.distance[i], _distances(vectors[part], self.queries[i])])
            n = np.concatenate([self.nearest[i], ids[part]])
            best = np.lexsort((n, d))[: self.k]
            self.distance[i], self.nearest[i] = d[best], n[best]
            self.radius[i] = min(self.radius[i], self.distance[i, -1])

    def found(self) -> pa.RecordBatch:
        q, r = np.nonzero(self.distance < np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.nearest[q, r]), pa.array(self.distance[q, r])], names=["query_id", "vec_id", "score"])


def _distances(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - q) ** 2).sum(1))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "embedding")
    books = fit(vectors, "embedding")
    index = stored(build_index(vectors, books, "embedding"))
    return search(index, vectors.filter("vec_id % 100 = 0"), books, "vec_id", "embedding")
