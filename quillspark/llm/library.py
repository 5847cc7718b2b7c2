"""Ids through the tokenizers library, each distinct piece of a batch once, and no piece that is still known."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bpe
from .bpe import Ragged
from .tokens import special_strings, specials

if TYPE_CHECKING:
    from tokenizers import Tokenizer

GROUP = 128  # words that go through the library in one text
KNOWN = 200_000  # pieces whose ids are held, besides those of the batch
KNOWN_BYTES = 64  # of a piece that it holds
SEPARATORS = "[\x1c-\x1f]"  # white space to Arrow alone: such texts stay whole
PLAIN = re.compile(r" ?\S+")


class Known:
    """Ids of the pieces that were met. Where they get more than KNOWN, those stay that came again, or if
    these are too many, the last batch's."""

    def __init__(self):
        self._hold(pa.array([], pa.string()), Ragged(np.zeros(0, np.uint32), np.zeros(1, np.int64)), np.zeros(0, bool))

    def _hold(self, pieces: pa.Array, ids: Ragged, again: np.ndarray) -> None:
        self.pieces, self.ids, self.again = pieces, ids, again

    def __call__(self, pieces: pa.Array, encode: Callable[[pa.Array], Ragged]) -> Ragged:
        """Ids of distinct pieces; only new ones are encoded."""
        found = pc.index_in(pieces, value_set=self.pieces)
        fresh = found.is_null()
        new = pieces.filter(fresh)
        made = encode(new)
        fresh = fresh.to_numpy(zero_copy_only=False)
        at = found.drop_null().to_numpy()
        self.again[at] = True
        old = self.ids.take(at)
        counts = np.zeros(len(pieces), np.int64)
        counts[fresh], counts[~fresh] = made.counts, old.counts
        out = Ragged.of(np.zeros(int(counts.sum()), np.uint32), counts)
        mine = np.repeat(fresh, counts)
        out.values[mine], out.values[~mine] = made.values, old.values
        short = pc.less_equal(pc.binary_length(new), KNOWN_BYTES)
        new, made = new.filter(short), made.take(np.flatnonzero(short.to_numpy(zero_copy_only=False)))
        if len(new):
            self._add(new, made)
        return out

    def _add(self, new: pa.Array, made: Ragged) -> None:
        pieces, ids, again = self.pieces, self.ids, self.again
        if len(pieces) + len(new) > KNOWN:
            kept = np.flatnonzero(again) if np.count_nonzero(again) + len(new) <= KNOWN else np.zeros(0, np.int64)
            pieces, ids, again = pieces.take(pa.array(kept)), ids.take(kept), np.zeros(len(kept), bool)
        self._hold(pa.concat_arrays([pieces, new]), joined(ids, made), np.append(again, np.zeros(len(new), bool)))


class Library:
    """A vocabulary of the tokenizers library. Plain words, of letters only, go through it many
    in one text and are told apart by the tokens that begin or end a word; all else one by
    one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run in parallel already
        from tokenizers import Tokenizer

        self.pattern, self.special, self.special_strings = bpe.split_pattern(), specials(path), special_strings(path)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix = model.get("end_of_word_suffix")
        self.space = space = next(c for c, b in bpe.byte_alphabet().items() if b == 32)
        self.bytes = {b: c for c, b in bpe.byte_alphabet().items() if b != 32}
        self.line = model["vocab"].get(next(c for c, b in bpe.byte_alphabet().items() if b == 10))
        self.edge = np.zeros(max(model["vocab"].values()) + len(self.special_strings) + 1, bool)
        for t, i in model["vocab"].items():
            self.edge[i] = t.endswith(self.suffix) if self.suffix else t.startswith(space)

    @functools.cached_property
    def plain(self) -> Tokenizer | None:
        """The vocabulary's model behind a split at white space alone, as words of letters need no pattern; none
        where a special string might be in them."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        if self.special and any(map(str.isalpha, self.special_strings)):
            return None
        plain = Tokenizer(self.library.model)
        plain.pre_tokenizer = WhitespaceSplit()
        return plain

    def _written(self, words: list[str]) -> str:
        """Words as the model has them, with spaces between."""
        text = " ".join(words)
        if self.suffix:
            text = text.lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.bytes)
        return text if self.suffix else self.space + text.replace(" ", " " + self.space)

    def _ids(self, texts: list[str]) -> Ragged:
        return self._through(self.library, texts)

    @staticmethod
    def _through(library: Tokenizer, texts: list[str]) -> Ragged:
        lists = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        counts = list(map(len, lists))
        return Ragged.of(np.fromiter(itertools.chain.from_iterable(lists), np.uint32, sum(counts)), counts)

    def words(self, words: list[str]) -> Ragged:
        """Ids of each word (with a space in front, where the vocabulary keeps it)."""
        groups = [words[k : k + GROUP] for k in range(0, len(words), GROUP)]
        if self.plain is None:
            found = self._ids([("" if self.suffix else " ") + " ".join(g) for g in groups])
        else:
            found = self._through(self.plain, list(map(self._written, groups)))
        edges = np.flatnonzero(self.edge[found.values])
        bounds = np.append(0, edges + 1) if self.suffix else np.append(edges, len(found.values))
        if len(bounds) != len(words) + 1 or bounds[0] != 0 or bounds[-1] != len(found.values):
            return self._ids(words if self.suffix else [" " + w for w in words])  # not one edge each
        return Ragged(found.values, bounds)

    def lines(self, pieces: list[str]) -> Ragged:
        """Ids of pieces without white space but a space in front: many in one text, one on each
        line, as a line's end is a token of its own before any of them."""
        groups = [pieces[k : k + GROUP] for k in range(0, len(pieces), GROUP)]
        found = self._ids(["\n".join([*g, ""]) for g in groups])
        ends = np.flatnonzero(found.values == self.line)
        if len(ends) != len(pieces):
            return self._ids(pieces)
        counts = np.diff(np.append(-1, ends)) - 1
        return Ragged.of(np.delete(found.values, ends), counts)

    def other(self, pieces: list[str]) -> Ragged:
        """Ids of pieces that aren't words."""
        single = np.ones(len(pieces), bool)
        if not self.suffix:
            single = np.array([not PLAIN.fullmatch(p) or bool(self.special and self.special.search(p)) for p in pieces], bool)
        parts = self.lines([p for p, s in zip(pieces, single, strict=True) if not s]), self._ids([p for p, s in zip(pieces, single, strict=True) if s])
        at = np.concatenate([np.flatnonzero(~single), np.flatnonzero(single)])
        return joined(*parts).take(np.argsort(at))

    def pieces(self, found: bpe.Pieces, known: tuple[Known, Known]) -> Ragged:
        words = known[0](found.words.cast(pa.string()), lambda new: self.words(new.to_pylist()))
        return joined(words, known[1](pa.array(found.others, pa.string()), lambda new: self.other(new.to_pylist())))

    def __call__(self, texts: pa.Array, known: tuple[Known, Known] | None = None, strings: Known | None = None) -> Ragged:
        """Ids of whole texts, as the library gives them without adding special tokens. ``known`` is
        what is known of words and of other pieces, ``strings`` of what lies between white space."""
        known = known or (Known(), Known())
        if self.suffix:
            return self._strings(texts, known, strings or Known())
        rows, found = bpe.pieces(texts, self.pattern, self.special)
        return rows.through(found.table.through(self.pieces(found, known)))

    def _strings(self, texts: pa.Array, known: tuple[Known, Known], strings: Known) -> Ragged:
        """The vocabulary drops white space, so a text is the sequence of what lies between."""

        def encode(new: pa.Array) -> Ragged:
            found = bpe.Pieces(new, lambda c: [c], pc.ascii_lower)  # the library lowers it as well
            return found.table.through(self.pieces(found, known))

        odd = pc.match_substring_regex(texts, SEPARATORS)
        rows, between = bpe.chunks(pc.utf8_split_whitespace(pc.if_else(odd, "", texts)))
        ids = strings(between, encode)
        whole = np.flatnonzero(odd)
        if len(whole):  # its one part, empty so far, becomes the text
            coded = texts.filter(odd).dictionary_encode()
            rows.values[rows.starts[whole]] = coded.indices.to_numpy() + len(between)
            ids = joined(ids, known[1](coded.dictionary, lambda new: self.other(new.to_pylist())))
        return rows.through(ids)


def joined(*parts: Ragged) -> Ragged:
    return Ragged.of(np.concatenate([p.values for p in parts]), np.concatenate([p.counts for p in parts]))


@functools.lru_cache(1)  # a vocabulary, whatever the texts
def library(path: str) -> Library:
    return Library(path)


@functools.lru_cache(1)  # bounded by KNOWN and KNOWN_BYTES
def memory(path: str) -> tuple[tuple[Known, Known], Known]:
    """What a process knows of words, of other pieces, and of what lies between white space, from one task to the next."""
    return (Known(), Known()), Known()
