"""Byte-pair merging in numpy, shared by the token operators.

Nothing here knows about Spark: these are the per-task helpers that the Arrow
functions in ``tokens.py``, ``token_files.py`` and ``packing.py`` call.

Rows of equal length bucket form one padded matrix.  In each round every row
merges its leftmost pair of minimum rank; pair ranks come from an open-addressed
hash table kept in numpy arrays.  Rows without a mergeable pair leave the matrix
(compaction), and as every remaining row has lost one symbol the matrix narrows
by one column a round.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

NONE = np.int32(2**31 - 1)  # rank of a pair that does not merge
CELLS = 1 << 18  # of one matrix: longer rows have fewer rows beside them
WIDE = 256  # columns from which a round merges every occurrence of a row's pair

# --- fixed values: letters and numbers of newer Unicode versions, which the
# tokenizer libraries still treat as neither (first and last code point) ---------
NEWER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2
a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1
1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20
18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96
1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e
2cea2-2cead 323b0-33479 3d000-3fc3f
"""
MARKS = ".,;:!?"  # a run of these after a word is one piece
LATIN = "^[A-Za-zÀ-ÖØ-öø-įıĲ-ɏ]+$"  # letters to every library, and in lower case as well


def split_pattern() -> regex.Pattern:
    """The public split pattern with the classes that the tokenizer libraries use."""
    newer = "".join("\\U{:0>8}-\\U{:0>8}".format(*r.split("-")) for r in NEWER.split())
    classes = {
        r"\p{L}": f"[\\p{{L}}--[{newer}]]",
        r"\p{N}": f"[\\p{{N}}--[{newer}]]",
        r"[^\s\p{L}\p{N}]": f"[[^\\s\\p{{L}}\\p{{N}}]||[{newer}]]",
    }
    names = "|".join(regex.escape(c) for c in sorted(classes, key=len, reverse=True))
    return regex.compile(regex.sub(names, lambda m: classes[m[0]], public_tokenizers.PATTERN), regex.V1)


@dataclass
class Ragged:
    """Rows of different lengths: row i is values[starts[i]:starts[i + 1]]."""

    values: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, counts: Iterable[int] | np.ndarray) -> Ragged:
        counts = np.asarray(counts, np.int64)
        return cls(values, np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def take(self, rows: np.ndarray) -> Ragged:
        n = self.counts[rows]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[rows] - (ends - n), n)
        return Ragged.of(self.values[at], n)

    def through(self, other: Ragged) -> Ragged:
        """Each value replaced by the row of ``other`` that it numbers."""
        taken = other.take(self.values)
        return Ragged(taken.values, taken.starts[self.starts])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each row the sum of the weights that its values number."""
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(weights[self.values], dtype=np.int64)])
        return total[self.starts[1:]] - total[self.starts[:-1]]


def bytes_of(texts: pa.Array) -> Ragged:
    """The UTF-8 bytes of each text."""
    if not len(texts):
        return Ragged(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = texts.cast(pa.large_string()).buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return Ragged(flat[starts[0] : starts[-1]], starts - starts[0])


class PairTable:
    """Hash table (left, right) -> (rank, merged id), looked up for whole arrays."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.uint64), np.asarray(right, np.uint64)
        keys = (left << np.uint64(32)) | right
        bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            where, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[where >= 0]
            put, at = todo[first], slot[first]
            self.keys[at], self.rank[at], self.merged[at] = keys[put], rank[put], merged[put]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left, right):
        """Ranks (NONE where the pair does not merge) and merged ids."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            open_ = open_[(found != keys[open_]) & (found != np.uint64(2**64 - 1))]
        hit = self.keys[slot] == keys
        return np.where(hit, self.rank[slot], NONE), self.merged[slot]


class Merger:
    """Merges rows of symbols by one pair table."""

    def __init__(self, byte_ids: np.ndarray, pairs: PairTable, token_bytes: list[bytes], in_rank_order: bool):
        self.byte_ids, self.pairs, self.token_bytes = byte_ids, pairs, token_bytes
        self.in_rank_order = in_rank_order  # every merge only makes pairs of higher rank
        self.table = Ragged.of(np.frombuffer(b"".join(token_bytes), np.uint8), [len(t) for t in token_bytes])
        self.joined = np.zeros((256, 256), bool)  # bytes that some token has side by side
        for t in token_bytes:
            b = np.frombuffer(t, np.uint8)
            self.joined[b[:-1], b[1:]] = True

    # ---- vocabularies --------------------------------------------------------
    @classmethod
    def from_file(cls, path: str) -> Merger:
        return cls.from_json(path) if path.endswith(".json") else cls.from_ranks(path)

    @classmethod
    def from_ranks(cls, path: str) -> Merger:
        """A rank file: one base64 token and its rank on each line."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        rows = [
            (ranks[t[:i]], ranks[t[i:]], r, r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        by_id = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            by_id[r] = t
        byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        ordered = all(r > (a if len(by_id[a]) > 1 else -1) and r > (b if len(by_id[b]) > 1 else -1) for a, b, r, _ in rows)
        return cls(byte_ids, PairTable(*zip(*rows, strict=True)), by_id, ordered)

    @classmethod
    def from_json(cls, path: str) -> Merger:
        """A byte-level model with a vocabulary and an ordered list of merges."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, to_byte = model["vocab"], byte_alphabet()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rows = [(vocab[a], vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(merges)]
        by_id = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            by_id[i] = bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode()
        char = {b: c for c, b in to_byte.items()}
        byte_ids = np.array([vocab[char[i]] for i in range(256)], np.int32)
        made: dict[int, int] = {}
        for _, _, i, m in rows:
            made.setdefault(m, i)
        ordered = len({m for *_, m in rows}) == len(rows) and all(i > made.get(a, -1) and i > made.get(b, -1) for a, b, i, _ in rows)
        return cls(byte_ids, PairTable(*zip(*rows, strict=True)), by_id, ordered)

    # ---- merging -------------------------------------------------------------
    def encode(self, pieces: pa.Array) -> Ragged:
        """Ids of each piece."""
        whole = bytes_of(pieces)
        # no merge joins two bytes that no token has side by side, so long pieces are cut there
        long_ = np.repeat(whole.counts >= WIDE, whole.counts)
        cut = np.zeros(len(whole.values) + 1, bool)
        cut[1:-1] = long_[1:] & ~self.joined[whole.values[:-1], whole.values[1:]]
        cut[whole.starts] = True
        rows = Ragged(whole.values, np.flatnonzero(cut))
        ids = self._rows(rows)
        return Ragged(ids.values, ids.starts[np.searchsorted(rows.starts, whole.starts)])

    def _rows(self, raw: Ragged) -> Ragged:
        """Ids of rows of bytes, none of them empty."""
        lengths = raw.counts
        single = np.flatnonzero(lengths == 1)
        done = [(single, np.ones(len(single), np.int64), self.byte_ids[raw.values[raw.starts[single]]])]
        low = 2
        while low <= lengths.max(initial=0):  # buckets 2-3, 4-7, 8-15, ...
            rows = np.flatnonzero((lengths >= low) & (lengths < 2 * low))
            step = max(1, CELLS // (2 * low))
            for k in range(0, len(rows), step):
                self._bucket(raw, rows[k : k + step], low >= WIDE, done)
            low *= 2
        rows, counts, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return Ragged.of(ids, counts).take(np.argsort(rows))

    def _bucket(self, raw: Ragged, rows: np.ndarray, wide: bool, done: list) -> None:
        mine = raw.take(rows)
        n, width = len(rows), int(mine.counts.max())
        inside = np.arange(width) < mine.counts[:, None]
        sym = np.full((n, width), -1, np.int32)
        sym[inside] = self.byte_ids[mine.values]
        rank = np.full((n, width - 1), NONE, np.int32)
        both = inside[:, 1:]
        rank[both] = self.pairs(sym[:, :-1][both], sym[:, 1:][both])[0]
        step = self._every if wide else self._leftmost
        while len(rows):
            live = rank.min(axis=1, initial=NONE) < NONE
            if not live.all():
                self._finish(rows[~live], sym[~live], done)
                rows, sym, rank = rows[live], sym[live], rank[live]
            if len(rows):
                sym, rank = step(sym, rank)

    def _leftmost(self, sym, rank):
        """Merges the leftmost pair of minimum rank of every row."""
        line, width = np.arange(len(sym)), sym.shape[1]
        at = rank.argmin(axis=1)  # leftmost of the smallest
        _, new = self.pairs(sym[line, at], sym[line, at + 1])
        cols = np.arange(width - 1)
        sym = np.take_along_axis(sym, cols + (cols > at[:, None]), axis=1)
        sym[line, at] = new
        cols = np.arange(width - 2)
        rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), axis=1)
        for side in (at - 1, at):  # the two pairs that hold the new symbol
            ok = (side >= 0) & (side < width - 2)
            self._rank(sym, rank, line[ok], side[ok])
        return sym, rank

    def _every(self, sym, rank):
        """Merges the pairs of minimum rank of every row from the left, all that don't
        overlap: where no merge makes a pair of so low a rank, that is what as many rounds
        of leftmost merges do; other rows merge their leftmost pair. Rows stay in the matrix;
        long ones take fewer rounds."""
        n, width = sym.shape
        cols = np.arange(width - 1)
        hit = rank == rank.min(axis=1)[:, None]
        run = hit & ~np.pad(hit, ((0, 0), (1, 0)))[:, :-1]
        first = np.maximum.accumulate(np.where(run, cols, 0), axis=1)
        hit &= (cols - first) % 2 == 0  # every second of pairs that overlap
        i, j = np.nonzero(hit)
        made = self.pairs(sym[i, j], sym[i, j + 1])[1]
        if not self.in_rank_order:  # rows in which a merge makes a pair of so low a rank
            before = np.where(j > 0, sym[i, np.maximum(j - 1, 0)], -1)
            after = np.where(j + 2 < width, sym[i, np.minimum(j + 2, width - 1)], -1)
            low = np.full(len(i), NONE)
            for left, right in ((before, made), (made, after), (made, made)):
                real = (left >= 0) & (right >= 0)
                low[real] = np.minimum(low[real], self.pairs(left[real], right[real])[0])
            strict = np.zeros(n, bool)
            strict[i[low <= rank[i, j]]] = True
            hit[strict] = False  # merge their leftmost pair alone
            hit[strict, rank[strict].argmin(axis=1)] = True
            i, j = np.nonzero(hit)
            made = self.pairs(sym[i, j], sym[i, j + 1])[1]
        sym[i, j] = made
        keep = sym >= 0
        keep[i, j + 1] = False
        to = np.cumsum(keep, axis=1) - 1
        left = int(to[:, -1].max()) + 1
        line, col = np.nonzero(keep)
        new = np.full((n, left), -1, np.int32)
        new[line, to[line, col]] = sym[line, col]
        ranks = np.full((n, max(left - 1, 0)), NONE, np.int32)
        inner = col < width - 1
        line, col = line[inner], col[inner]
        ok = to[line, col] < left - 1
        ranks[line[ok], to[line[ok], col[ok]]] = rank[line[ok], col[ok]]
        at = to[i, j]
        for side in (at - 1, at):
            ok = (side >= 0) & (side < left - 1)
            self._rank(new, ranks, i[ok], side[ok])
        return new, ranks

    def _rank(self, sym, rank, i, j) -> None:
        right = sym[i, j + 1]
        real = right >= 0
        rank[i, j] = NONE
        rank[i[real], j[real]] = self.pairs(sym[i[real], j[real]], right[real])[0]

    @staticmethod
    def _finish(rows, sym, done) -> None:
        keep = sym >= 0
        done.append((rows, keep.sum(axis=1), sym[keep]))

    def decode(self, ids: Ragged) -> Ragged:
        """The bytes of each row's ids, gathered in one step."""
        return ids.through(self.table)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Names:
    """Numbers strings in the order in which they come."""

    def __init__(self):
        self.index: dict[str, int] = {}

    def __call__(self, s: str) -> int:
        return self.index.setdefault(s, len(self.index))


def chunks(parts: pa.ListArray) -> tuple[Ragged, pa.Array]:
    """Lists of strings as numbers into the distinct ones."""
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Ragged.of(codes, pc.list_value_length(parts).to_numpy(zero_copy_only=False)), coded.dictionary


class Pieces:
    """What distinct strings fall apart into: one row of piece numbers a string. ``words``
    are the distinct words of Latin letters, perhaps with marks after them (a piece of their
    own); they have the lowest numbers. All other pieces are in ``others``."""

    def __init__(self, strings: pa.Array, cut: Callable[[str], list[str]], fold: Callable[[pa.Array], pa.Array] = lambda a: a):
        core = pc.utf8_rtrim(strings, characters=MARKS)
        word = pc.match_substring_regex(core, LATIN)
        coded = fold(core.filter(word)).dictionary_encode()
        self.words, self.name = coded.dictionary, Names()
        sized, whole = (pc.utf8_length(x.filter(word)).to_numpy(zero_copy_only=False) for x in (core, strings))
        marked = whole > sized
        tails = [s[n:] for s, n in zip(strings.filter(word).filter(pa.array(marked)).to_pylist(), sized[marked].tolist(), strict=True)]
        rest = [cut(s) for s in strings.filter(pc.invert(word)).to_pylist()]
        is_word = word.to_numpy(zero_copy_only=False)
        counts = np.ones(len(strings), np.int64)
        counts[is_word] += marked
        counts[~is_word] = list(map(len, rest))
        self.table = Ragged.of(np.zeros(int(counts.sum()), np.int64), counts)
        flat, at = self.table.values, self.table.starts[:-1]
        flat[at[is_word]] = coded.indices.to_numpy(zero_copy_only=False)
        flat[at[is_word][marked] + 1] = self.number(tails)
        flat[np.repeat(~is_word, counts)] = self.number([p for found in rest for p in found])

    def number(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.name, pieces), np.int64, len(pieces)) + len(self.words)

    def add(self, rows: list[list[str]]) -> int:
        """More rows at the end of the table; gives the number of the first."""
        first = len(self.table.starts) - 1
        values = np.concatenate([self.table.values, self.number([p for r in rows for p in r])])
        self.table = Ragged.of(values, np.concatenate([self.table.counts, np.array(list(map(len, rows)), np.int64)]))
        return first

    @property
    def others(self) -> list[str]:
        return list(self.name.index)


def pieces(texts: pa.Array, pattern: regex.Pattern, special: regex.Pattern | None = None) -> tuple[Ragged, Pieces]:
    """Splits texts into pieces, the matches of the pattern: rows of chunk numbers (one row a
    text), and the pieces of each chunk. Words have a space in front that isn't written.

    A text splits at single spaces into chunks that keep the space in front.  As long as no
    space touches other white space, no match of the pattern crosses a chunk's end, so a
    chunk's pieces never depend on its neighbours, and each distinct chunk is split once.
    Texts in which one does, or with special strings (pieces of their own), are split by
    the pattern as a whole and are one chunk.
    """
    rows, strings = chunks(pc.split_pattern(texts, " "))
    found = Pieces(strings, lambda c: pattern.findall(" " + c))
    first, last = rows.starts[:-1], rows.starts[1:] - 1  # a text has one chunk at least
    front = pc.match_substring_regex(strings, r"^(\s|[\p{Z}\x0b\x1c-\x1f\x85]|$)").to_numpy(zero_copy_only=False)
    back = pc.match_substring_regex(strings, r"(\s|[\p{Z}\x0b\x1c-\x1f\x85])$").to_numpy(zero_copy_only=False)
    touched, after, codes = front[rows.values], back[rows.values], rows.values.copy()
    touched[first] = after[last] = False
    whole = set((np.searchsorted(rows.starts, np.flatnonzero(touched | after), "right") - 1).tolist())
    if special is not None:
        whole |= set(np.flatnonzero(pc.match_substring_regex(texts, special.pattern)).tolist())
    # the first chunk of a text has no space in front
    start, where = np.unique(codes[first], return_inverse=True)
    codes[first] = found.add([pattern.findall(c) for c in strings.take(pa.array(start)).to_pylist()]) + where
    if not whole:
        return Ragged(codes, rows.starts), found
    order = np.array(sorted(whole))
    size = rows.counts
    inside = np.ones(len(size), bool)
    inside[order] = False
    kept = codes[np.repeat(inside, size)]
    size[order] = 1
    out = Ragged.of(np.zeros(int(size.sum()), np.int64), size)
    out.values[np.repeat(inside, size)] = kept
    out.values[out.starts[order]] = found.add([split_whole(texts[i].as_py(), pattern, special) for i in order.tolist()]) + np.arange(len(order))
    return out, found


def split_whole(text: str, pattern: regex.Pattern, special: regex.Pattern | None) -> list[str]:
    out, at = [], 0
    for m in special.finditer(text) if special is not None else ():
        out += [*pattern.findall(text[at : m.start()]), m[0]]
        at = m.end()
    return out + pattern.findall(text[at:])


def strings_of(found: Pieces) -> pa.Array:
    """The pieces by their numbers, words with their space."""
    return pa.concat_arrays([pc.binary_join_element_wise("", found.words, " "), pa.array(found.others, pa.string())])


def encode_texts(texts: pa.Array, merger: Merger, pattern: regex.Pattern) -> Ragged:
    """Ids of whole texts; each distinct piece is merged once."""
    rows, found = pieces(texts, pattern)
    return rows.through(found.table.through(merger.encode(strings_of(found))))
