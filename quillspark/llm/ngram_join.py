"""N-gram Jaccard join: documents whose word-shingle sets are similar, and their groups.

1. A pass over the texts gives each row its set's size, a 128-bit key of the set and
   signatures: linked sets of at most m shingles differ in at most h of them, h known from
   m, so if hashing deals the shingles into p > h parts, they agree in p - h parts or more.
   A set's signatures are hashes of its h + 1 fullest parts; linked sets share one of
   them. Unlike a single shingle, the shingles of a whole part are seldom shared by chance.
2. A task passes on one row for each signature and FLUSH_ROWS rows, and links the others that
   have it to that one; so of a signature that all rows have, one in FLUSH_ROWS reaches
   the shuffle, where the smallest row of a signature stands for it.
3. Connected rows form blocks: a superset of the groups.
4. Within blocks a T-occurrence search finds the links exactly: of the inverted lists of
   a query's shingles, the short ones are merged by a heap that skips what can't reach
   its share of the overlap, the long ones are probed by binary search for the rest
   (DivideSkip). Every document is a query once; what a query has found is in its group and
   leaves the index, so that a group of near copies is searched by its first one alone.
5. Blocks too large for one task, and all of them where parts have so few shingles (below FEW) that
   passages chain the more documents the more there are, fall apart by prefixes: of linked sets, each has one of the
   other's rarest shingles among its own rarest (so many that fewer could not be all that
   differ), by one order of all shingles. A passage that many documents share is never
   rare. Of the rows that share one rare shingle those are linked that their counts allow: a set's shingles are counted in so many buckets that four fall into
   one; the sum over the buckets of the smaller count is at least the overlap of two sets, and is
   too small for a link if they share but a passage. Only these counts, a quarter of a byte a shingle, go to the
   groups. What such links connect is searched as blocks are; what is too large even then
   (a huge group of near copies), is first compared with one of its documents; what is
   linked with it is one group already, and only the others are searched for, within the
   groups that share one rare shingle; in one too large still, a task indexes one part of
   it and asks for one share of the others.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop_stored, join_small, numbered, released, scratch, spare, stored
from .components import components

FLUSH_ROWS = 16384  # rows whose signatures a task compares before it passes them on
DEALS = 4  # times that a set is dealt into parts before single shingles sign for it
FEW = 8  # shingles of a part on average, below which a shared passage fills a part often
BLOCK_SHINGLES = 400_000  # shingles of a block that one task indexes (3.2 MB)
RARE = 32  # occurrences up to which all shingles of large blocks count as equally rare
COMMON = 1_000_000  # shingles at most whose occurrences are told to all tasks (16 MB)
SHORT = 64  # documents of an inverted list that is merged rather than probed
PER_BUCKET = 4  # shingles of a set that fall into one bucket of its counts, or half as many
FACT_SHINGLES = 200_000  # shingles of the rows whose rare ones one task lists
CELL_ROWS, CELL_SHINGLES = 4096, 1 << 25  # rows whose counts one task compares, and their shingles (16 MB of counts)


# ---- sets --------------------------------------------------------------------------
class Shingles:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int, room: int = 200_000):
        self.n, self.room = n, room
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > self.room:
            self.words = {}
        known = self.words
        try:
            codes = [known[w] for w in words]
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            codes = [known[w] for w in words]
        h = np.array(codes, np.uint64)
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = mix(out ^ h[k : len(h) - n + 1 + k])
        return np.unique(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(ratio: float) -> Iterator[tuple[int, int]]:
    """Consecutive bands of sizes (smallest, largest)."""
    lo = 1
    while True:
        hi = max(lo, int(lo * ratio))
        yield lo, hi
        lo = hi + 1


class Signatures:
    """Hashes of parts of a set, one of which any set linked with it at ``percent`` / 100
    or more has too.

    Sizes lie in bands, and a set is looked for in its own and in the next if a linked set
    can be there. Linked sets of at most m shingles differ in at most
    h = 2 m (100 - percent) / (100 + percent). Of p parts at least p - h agree; each set
    leaves out its p - h - 1 lowest in one order of all parts (fewest shingles first), so
    the highest part that agrees is left in by both. Empty parts have no signature: where
    more than h parts aren't empty, one of these agrees. Sets of fewer are dealt out again
    by another hash, at most DEALS times, and after that sign with their h + 1 first
    shingles in one order of all, of which linked sets share one.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.made: list[tuple[int, int]] = []
        self.more = bands(100 / percent)  # so that linked sizes are at most one band apart

    def bands_of(self, size: int) -> list[int]:
        """The band of the size, and the next if a linked set can be in it."""
        while not self.made or self.made[-1][0] <= size:
            self.made.append(next(self.more))
        at = next(i for i, (lo, hi) in enumerate(self.made) if lo <= size <= hi)
        return [at] + ([at + 1] if 100 * size >= self.percent * self.made[at + 1][0] else [])

    def parts(self, s: np.ndarray, band: int, deal: int = 0) -> np.ndarray:
        differ = 2 * self.made[band][1] * (100 - self.percent) // (100 + self.percent)
        mark = np.uint64(((band + 1) << 40) + (deal << 32))
        if deal == DEALS:
            return mix(np.sort(mix(s))[: differ + 1] ^ mix(np.array([mark])))
        p = differ + 1 + differ // 8
        dealt = mix(s ^ np.uint64(deal << 32)) if deal else s
        part = (dealt % np.uint64(p)).astype(np.int64)
        size = np.bincount(part, minlength=p)
        some = size > 0
        sums = np.zeros(p, np.uint64)
        sums[some] = np.add.reduceat(mix(s)[np.argsort(part, kind="stable")], (np.cumsum(size) - size)[some])
        hashes = mix(sums ^ mix(np.arange(p, dtype=np.uint64) + mark))
        kept = np.lexsort((hashes, size))[p - differ - 1 :]
        found = hashes[kept[some[kept]]]
        return found if some.sum() > differ else np.concatenate([found, self.parts(s, band, deal + 1)])

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.concatenate([self.parts(s, band) for band in self.bands_of(len(s))]).view(np.int64)


# ---- search within a block -----------------------------------------------------------
def merge_skip(lists: list[list[int]], need: int) -> tuple[list[int], list[int]]:
    """Documents that at least ``need`` of some ascending lists hold, and how many do: a heap
    of the lists' heads; where too few have the least document, all lists that could not
    make up for it jump ahead together."""
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    at = [0] * len(lists)
    docs, counts = [], []
    while len(heap) >= need:
        least = heap[0][0]
        popped = []
        while heap and heap[0][0] == least:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            docs.append(least)
            counts.append(len(popped))
            bound = least + 1
        else:
            while len(popped) < need - 1:  # as many lists remain, by the loop's condition
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            bound = heap[0][0]
        for i in popped:
            at[i] = bisect_left(lists[i], bound, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))
    return docs, counts


class Index:
    """Inverted lists of some sets, for searches with a least overlap. Documents may leave; the
    lists are made anew when half have left."""

    def __init__(self, sets: list[np.ndarray], members: list[int]):
        self.sets = sets
        self._make(np.array(members, np.int64))

    def _make(self, members: np.ndarray) -> None:
        self.left = np.zeros(len(self.sets), bool)
        self.inside = np.zeros(len(self.sets), bool)
        self.inside[members] = True
        self.gone, self.size = 0, len(members)
        sets = [self.sets[m] for m in members.tolist()]
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        owner = np.repeat(members, np.array([len(x) for x in sets], np.int64))
        order = np.argsort(flat, kind="stable")  # owners ascend within a token
        flat, self.docs = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.tokens, self.starts, self.members = flat[first], np.append(first, len(flat)), members

    def leave(self, docs: np.ndarray) -> None:
        self.left[docs] = True
        self.gone += len(docs)
        if self.gone * 2 > self.size:
            self._make(self.members[~self.left[self.members]])

    def occurrences(self, query: np.ndarray, least: int, alone: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Documents that at least ``least`` of the query's lists hold, and how many do; lists of
        no more than ``alone`` documents (the query itself) are left out."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.tokens):
            return none
        at = np.searchsorted(self.tokens, query)
        at = np.minimum(at, len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        at = at[self.starts[at + 1] - self.starts[at] > alone]
        if len(at) < least:
            return none
        length = self.starts[at + 1] - self.starts[at]
        order = np.argsort(length, kind="stable")
        at, length = at[order], length[order]
        n_long = min(int(least / (0.01 * np.log2(length[-1] + 1) + 1)), least - 1, int((length > SHORT).sum()))
        cut = len(at) - n_long
        lists = [self.docs[self.starts[i] : self.starts[i + 1]] for i in at.tolist()]
        docs, counts = merge_skip([x.tolist() for x in lists[:cut]], least - n_long)
        left, found = np.array(docs, np.int64), np.array(counts, np.int64)
        keep = ~self.left[left]
        left, found = left[keep], found[keep]
        for done, postings in enumerate(lists[cut:]):
            if not len(left):
                break
            p = np.minimum(np.searchsorted(postings, left), len(postings) - 1)
            found = found + (postings[p] == left)
            keep = found >= least - (n_long - done - 1)  # what the lists still to come can make up
            left, found = left[keep], found[keep]
        return left, found

    def linked(self, query: np.ndarray, percent: int, alone: int = 0) -> np.ndarray:
        """Documents of the index whose sets are similar to the query's."""
        found, overlap = self.occurrences(query, max(1, -(-percent * len(query) // 100)), alone)
        sizes = np.array([len(self.sets[d]) for d in found.tolist()], np.int64)
        return found[100 * overlap >= percent * (sizes + len(query) - overlap)]


def block_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of a block."""
    index = Index(sets, list(range(len(sets))))
    reached = np.zeros(len(sets), bool)
    out = []
    for first in range(len(sets)):
        if reached[first]:
            continue
        reached[first] = True
        index.leave(np.array([first]))
        todo = [first]
        while todo:
            q = todo.pop()
            found = index.linked(sets[q], percent, int(index.inside[q]))
            reached[found] = True
            index.leave(found)
            out += ((ids[q], ids[d]) for d in found.tolist())
            todo += found.tolist()
    return out


def cell_links(ids: list[int], sets: list[np.ndarray], members: list[int], queries: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between the query positions and the members of an index, as far as they join what
    isn't joined yet (a spanning forest of the links)."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index, out = Index(sets, members), []
    for q in queries:
        for d in index.linked(sets[q], percent, int(index.inside[q])).tolist():
            a, b = find(q), find(d)
            if a != b:
                root[a] = b
                out.append((ids[q], ids[d]))
    return out


# ---- bounds of the overlap ---------------------------------------------------------------
def bucket_counts(s: np.ndarray) -> bytes:
    """How many shingles fall into each bucket, of which there is a power of two."""
    buckets = 16
    while buckets * PER_BUCKET < len(s):
        buckets *= 2
    return np.minimum(np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def folded(counts: np.ndarray) -> np.ndarray:
    """The counts of half as many buckets."""
    half = counts.shape[-1] // 2
    return counts[..., :half].astype(np.uint16) + counts[..., half:]


def possible_links(ids: list[int], sizes: list[int], counts: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A forest that joins all rows whose sets can be linked by their sizes and bucket counts."""
    size = np.array(sizes, np.int64)
    kinds: dict[int, np.ndarray] = {}  # number of buckets -> positions of the rows, by size
    for k in np.argsort(size, kind="stable").tolist():
        kinds.setdefault(len(counts[k]), []).append(k)
    kinds = {b: np.array(rows) for b, rows in kinds.items()}
    table = {b: np.frombuffer(b"".join(counts[k] for k in rows.tolist()), np.uint8).reshape(len(rows), b) for b, rows in kinds.items()}
    below = {b: folded(t) for b, t in table.items()}
    left, out = np.ones(len(ids), bool), []

    def near(q: int) -> np.ndarray:
        """Rows that are left and may be linked with a row."""
        mine, found = np.frombuffer(counts[q], np.uint8), []
        least, most = -(-percent * size[q] // 100), 100 * size[q] // percent
        for b, held in ((len(mine) // 2, table), (len(mine), table), (2 * len(mine), below)):
            if b not in kinds:
                continue
            rows = kinds[b]
            a, z = np.searchsorted(size[rows], [least, most + 1])
            at = np.arange(a, z)[left[rows[a:z]]]
            own = folded(mine) if b < len(mine) else mine
            if len(at):
                bound = np.minimum(held[b][at], own).sum(axis=1, dtype=np.int64)
                found.append(rows[at[bound * (100 + percent) >= percent * (size[q] + size[rows[at]])]])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    for first in range(len(ids)):
        todo = [first] if left[first] else []
        left[todo] = False
        while todo:
            q = todo.pop()
            rows = near(q)
            left[rows] = False
            out += ((ids[q], ids[k]) for k in rows.tolist())
            todo += rows.tolist()
    return out


# ---- the join ---------------------------------------------------------------------------
def ngram_groups(df: DataFrame, id_col: str, text_col: str = "text", n: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES, number: str | None = None) -> DataFrame:
    """One row for each row of ``df``: row (its ``number``), the id column,
    n_shingles, component (smallest id reachable by links) and stays (true for one row of
    each component: the one of smallest id, of equal ids the one of smallest number).

    Words are runs of other than ASCII white space, A-Z in lower case; a set has the
    distinct ``n``-word shingles, or the whole sequence if shorter. Rows link when
    100 * intersection >= percent * union.  Null, empty and blank texts have no
    shingles and link with nothing. Equal sets are searched once; null ids come last.
    Repeated rows are copies of one another. An empty table gives none. Other columns
    are ignored; where the id column has the name of another of these, that one gets a
    longer one. Texts of any length are taken whole. ``number`` is a column of row numbers that are the same in
    every scan (without it, those of ``numbered``); ``df`` is scanned more than once.
    """
    with scratch(df.sparkSession) as keep:
        if number is None:
            number = spare("row", df.columns)
            df = numbered(df, number)
        return keep(_groups(df, id_col, text_col, n, percent, block_shingles, number))


def _groups(df: DataFrame, id_col: str, text_col: str, n: int, percent: int, block_shingles: int, number: str) -> DataFrame:
    docs = df.select(F.col(number).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scan = stored(_signed(docs.select("row", "text"), n, percent))
    copies = scan.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = stored(copies.select("k1", "k2", "first"))
    # blocks: rows that share a signature in a task, and rows that stand for a signature in several
    over = scan.select("row", F.explode("signatures").alias("signature"))
    before = Window.partitionBy("signature").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    between = over.select("row", F.min("row").over(before).alias("b")).filter("row > b").distinct()
    within = scan.select("row", F.explode("firsts").alias("b"))
    block = _blocks(components(between.unionByName(within).select(F.col("row").alias("a"), "b")))
    fat, scan = scan, stored(scan.select("row", "n_shingles", "k1", "k2"))
    drop_stored(fat)  # the signatures are most of it
    sized = join_small(scan, block, ["row"], "inner", 48)
    sized = join_small(sized, copies, ["k1", "k2"], "left", 64).filter("first is null or first = row")
    sizes = sized.groupBy("block").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("docs"), F.min("row").alias("pivot")).filter("docs > 1")
    sizes = stored(sizes.withColumn("parts", F.ceil(F.col("total") / block_shingles).cast("int")))
    members = join_small(sized.select("row", "block", "n_shingles"), sizes.select("block", "parts", "pivot"), ["block"], "inner", 64)
    members = stored(members)
    texts = lambda rows: join_small(docs.select("row", "text"), rows, ["row"], "inner", 72)
    # where passages chain documents, the share of these in large blocks grows with the table: then no block is searched as it is
    chained = 100 + percent < 2 * FEW * (100 - percent)
    links = _whole(texts(members.filter(F.lit(not chained) & (F.col("parts") == 1))), n, percent)
    big = members if chained else members.filter("parts > 1")
    if not big.isEmpty():
        # these blocks fall apart by rare shingles and by what their counts allow
        facts = _prefixes(texts(big.select("row", "block")), n, percent, big.agg(F.sum("n_shingles")).first()[0])
        last = _sized(big, _blocks(components(_possible(facts, percent))), block_shingles)
        links = links.unionByName(_whole(texts(last.filter("parts = 1")), n, percent))
        if not last.filter("parts > 1").isEmpty():
            rare = facts.select("row", F.explode("rares").alias("rare"))
            links = links.unionByName(_large(stored(texts(last.filter("parts > 1"))), rare, n, percent, block_shingles))
    groups = components(links)
    # every row: its copies' first row, that row's group
    mine = join_small(scan, copies, ["k1", "k2"], "left", 64)
    mine = mine.select("row", "n_shingles", F.coalesce("first", "row").alias("id"))
    mine = join_small(mine, groups, ["id"], "left", 48)
    rooted = mine.select("row", "n_shingles", F.coalesce("root", "id").alias("root")).join(docs.select("row", "id"), "row")
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"), F.count("*").alias("size")).filter("size > 1")
    out = join_small(rooted, stored(best), ["root"], "left", 72)
    names = spare("row", [id_col]), spare("n_shingles", [id_col]), spare("component", [id_col]), spare("stays", [id_col])
    return out.select(
        F.col("row").alias(names[0]),
        F.col("id").alias(id_col),
        F.col("n_shingles").alias(names[1]),
        F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias(names[2]),
        (F.col("best").isNull() | (F.col("best.row") == F.col("row"))).alias(names[3]),
    )


def _blocks(found: DataFrame) -> DataFrame:
    """(row, block) of all rows of components (id, root), the roots too."""
    return stored(found.unionByName(found.select(F.col("root").alias("id"), "root").distinct()).select(F.col("id").alias("row"), F.col("root").alias("block")))


def _sized(members: DataFrame, block: DataFrame, block_shingles: int) -> DataFrame:
    """(block, row, n_shingles, pivot, parts): rows of blocks of two or more, and into how many parts a block is cut."""
    rows = join_small(members.select("row", "n_shingles"), block, ["row"], "inner", 48)
    sizes = rows.groupBy("block").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("docs"), F.min("row").alias("pivot")).filter("docs > 1")
    sizes = stored(sizes.select("block", "pivot", F.ceil(F.col("total") / block_shingles).cast("int").alias("parts")))
    return stored(join_small(rows, sizes, ["block"], "inner", 64))


def _possible(facts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join, within blocks, all rows that share a rare shingle and whose sizes and
    counts allow a link. Rare shingles of one row alone go at once; groups of the same rows count once; a group of more than CELL_ROWS rows or
    CELL_SHINGLES shingles is compared part by part."""
    mine = facts.select("row", F.col("size").cast("int").alias("size"), F.explode("rares").alias("rare"))
    shared = stored(mine.withColumn("n", F.count("*").over(Window.partitionBy("rare"))).filter("n > 1").drop("n"))
    who = F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("who")
    groups = shared.groupBy("rare").agg(F.count("*").alias("rows"), who, F.min("row").alias("least"), F.sum("size").alias("total"))
    groups = groups.groupBy("who", "rows", "least", "total").agg(F.min("rare").alias("rare"))
    groups = stored(groups.select("rare", F.ceil(F.greatest(F.col("rows") / CELL_ROWS, F.col("total") / CELL_SHINGLES)).cast("int").alias("parts")))
    own, other = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = join_small(shared, groups, ["rare"], "inner", 32).select("row", F.col("rare").alias("cell"), own.alias("own"), other.alias("other"))
    cells = cells.select("row", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = cells.join(facts.select("row", "size", "counts"), "row").select("cell", "i", "j", "row", "size", "counts")
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [])

        def links() -> pa.RecordBatch:
            found = possible_links(*held, percent)
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            for cell, i, j, row, size, counts in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (cell, i, j) != key and held[0]:
                    yield links()
                key = cell, i, j
                for x, value in zip(held, (row, size, counts), strict=True):
                    x.append(value)
        if held[0]:
            yield links()

    return dealt.mapInArrow(released(run), "a long, b long")


def _whole(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links within blocks that one task searches each."""
    return _search(rows.withColumns({"part": F.lit(0), "query": F.lit(True), "index": F.lit(True)}), n, percent)


def _large(rows: DataFrame, rare: DataFrame, n: int, percent: int, block_shingles: int) -> DataFrame:
    """Links within blocks too large for one task, as far as they join what isn't joined: first
    with one row of each, in every part of the block; then of the rows that aren't linked with
    it, within the groups that share one rare shingle (groups of the same rows count once). A
    group too large still is searched in cells of one part of it and one share of those rows."""
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = F.pmod(F.xxhash64("row"), F.col("parts"))
    index = rows.withColumns({"part": own.cast("int"), "query": F.lit(False), "index": F.lit(True)})
    pivot = rows.filter("row = pivot").withColumns({"part": every("parts"), "query": F.lit(True), "index": F.lit(False)})
    star = stored(_search(index.unionByName(pivot), n, percent))
    known = star.select(F.col("b").alias("row")).unionByName(star.select(F.col("a").alias("row"))).distinct()
    marked = join_small(rows.select("row", "block", "pivot", "n_shingles"), stored(known.withColumn("known", F.lit(True))), ["row"], "left", 32)
    marked = stored(marked.select("row", "block", "n_shingles", (F.col("known").isNull() & (F.col("row") != F.col("pivot"))).alias("other")))
    mine = join_small(rare.select("row", "rare"), marked, ["row"], "inner", 56)
    asked = F.when(F.col("other"), F.col("n_shingles"))
    groups = mine.groupBy("block", "rare").agg(
        F.count("*").alias("rows"), F.count_if("other").alias("others"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("who"), F.sum("n_shingles").alias("total"), F.sum(asked).alias("asked")
    )
    groups = groups.filter("rows > 1 and others > 0").groupBy("block", "who", "rows", "others").agg(F.min("rare").alias("rare"), F.first("total").alias("total"), F.first("asked").alias("asked"))
    groups = stored(groups.select("block", "rare", *(F.ceil(F.col(c) / block_shingles).cast("int").alias(to) for c, to in (("total", "parts"), ("asked", "shares")))))
    texts = rows.select("row", "text").join(join_small(mine, groups, ["block", "rare"], "inner", 40), "row")
    whole = F.col("parts") == 1
    together = texts.filter(whole).withColumns({"index": F.lit(True), "query": F.col("other"), "part": F.lit(0).cast("long")})
    held = texts.filter(~whole).withColumns({"index": F.lit(True), "query": F.lit(False), "share": every("shares")})
    held = held.withColumn("part", own.cast("long") * F.col("shares") + F.col("share")).drop("share")
    asking = texts.filter(~whole & F.col("other")).withColumns({"index": F.lit(False), "query": F.lit(True), "of": every("parts")})
    asking = asking.withColumn("part", F.col("of").cast("long") * F.col("shares") + F.pmod(F.xxhash64("row", F.lit(1)), F.col("shares"))).drop("of")
    cells = together.unionByName(held).unionByName(asking).withColumn("block", F.xxhash64("block", "rare"))
    return star.unionByName(_search(cells, n, percent))


def _prefixes(big: DataFrame, n: int, percent: int, total_shingles: int) -> DataFrame:
    """(row, size, rares, counts) of rows (row, text, block) of blocks that fall apart: the size of their set, its rarest
    shingles (those of one block have nothing in common with those of another) and its bucket counts, dealt out so
    that a task gets FACT_SHINGLES shingles."""
    spark = big.sparkSession

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for b in batches:
            for text in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], names=["shingle"])

    counts = stored(big.select("text").mapInArrow(released(listed), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") > RARE))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(RARE, total // COMMON)  # at most COMMON shingles occur more often
    often = counts.filter(F.col("n") > least).toPandas()
    common, rank = often["shingle"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(common)
    shared = spark.sparkContext.broadcast((common[order], rank[order]))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, (common, rank) = Shingles(n), shared.value
        for b in batches:
            prefixes, sizes, counted = [], [], []
            for block, text in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                s, mark = shingles(text.as_py()), mix(np.array([block], np.int64).view(np.uint64))
                at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
                times = np.where(common[at] == s, rank[at], 0) if len(common) else np.zeros(len(s), np.int64)
                order = np.lexsort((s, times))
                prefixes.append(mix(s[order[: len(s) - -(-percent * len(s) // 100) + 1]] ^ mark).view(np.int64))
                sizes.append(len(s))
                counted.append(bucket_counts(s))
            rares = _lists(np.array([len(x) for x in prefixes], np.int64), np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(sizes, pa.int64()), rares, pa.array(counted, pa.binary())], names=["row", "size", "rares", "counts"])

    made = big.select("block", "row", "text").mapInArrow(released(rare), "row long, size long, rares array<long>, counts binary")
    return stored(made.repartition(max(1, -(-total_shingles // FACT_SHINGLES))))


def _signed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """For each row: size and key of its set, the signatures it stands for (the first in its
    part of a task to have them) and the rows that stand for its others."""
    schema = "row long, n_shingles long, k1 long, k2 long, signatures array<long>, firsts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sign = Shingles(n), Signatures(percent)
        seen: list[np.ndarray] = []
        facts: list[tuple[int, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(seen)), [len(s) for s in seen])
            flat = np.concatenate(seen) if seen else np.zeros(0, np.int64)
            _, first, which = np.unique(flat, return_index=True, return_inverse=True)
            stands = owner[first][which]  # the first row with this signature
            new = np.zeros(len(flat), bool)
            new[first] = True
            rows = np.array([f[0] for f in facts], np.int64)
            kept = np.bincount(owner[new], minlength=len(seen))
            pairs = np.unique(owner[stands != owner] * np.int64(FLUSH_ROWS * 2) + stands[stands != owner])
            linked, to = pairs // (FLUSH_ROWS * 2), pairs % (FLUSH_ROWS * 2)
            arrays = [
                pa.array(rows),
                *(pa.array([f[i] for f in facts], pa.int64()) for i in (1, 2, 3)),
                _lists(kept, flat[new]),
                _lists(np.bincount(linked, minlength=len(seen)), rows[to] if len(to) else np.zeros(0, np.int64)),
            ]
            seen.clear()
            facts.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["row", "n_shingles", "k1", "k2", "signatures", "firsts"])

        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(text.as_py())
                key = xxhash.xxh3_128_intdigest(s.tobytes())
                facts.append((row, len(s), (key >> 64) - 2**63, (key & (2**64 - 1)) - 2**63))
                seen.append(sign(s) if len(s) else np.zeros(0, np.int64))
                if len(facts) == FLUSH_ROWS:
                    yield flush()
        if facts:
            yield flush()

    return docs.mapInArrow(released(run), schema)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _search(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) within each (block, part): its query rows against its index rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        rows.select("block", "part", "row", "query", "index", "text")
        .repartition(parts, "block", "part")
        .sortWithinPartitions("block", "part", "row", F.col("index").desc())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, key = Shingles(n), None
        ids: list[int] = []
        sets: list[np.ndarray] = []
        members: list[int] = []
        queries: list[int] = []

        def links() -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            if len(members) == len(queries) == len(ids) > 1:
                found = block_links(ids, sets, percent)
            elif members and queries:
                found = cell_links(ids, sets, members, queries, percent)
            for x in (ids, sets, members, queries):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(5)]
            for block, part, row, query, index, text in zip(*columns, b.column(5), strict=True):
                if (block, part) != key and ids:
                    yield links()
                key = block, part
                if not ids or ids[-1] != row:  # else a query that is in the index too
                    ids.append(row)
                    sets.append(shingles(text.as_py()))
                if index:
                    members.append(len(ids) - 1)
                if query:
                    queries.append(len(ids) - 1)
        if ids:
            yield links()

    return dealt.mapInArrow(released(run), "a long, b long")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_groups(documents(spark, sf_dir), "doc_id", n=3, percent=90)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
