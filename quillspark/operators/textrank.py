"""Key sentences by TextRank, one document at a time inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab

DAMPING, ROUNDS = 0.85, 30
HELD = 1 << 24  # edges of a document that are held, 270 MB; edges of further sentences are made again each round
AT_ONCE = 1 << 22  # cells and common tokens that are counted in one step


def _edges(rows: list[np.ndarray], start: int, holders: np.ndarray, starts: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Similarities of the sentences from ``start``, some sentences at a time: where the next ones begin, and
    (i, j, value) of the pairs with a common token."""
    n, lists = len(rows), np.diff(starts)
    work = np.array([n + lists[r].sum() for r in rows[start:]], np.int64)
    ends, at = np.cumsum(work), 0
    while at < len(work):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        block = rows[start + at : start + to]
        tokens = np.concatenate(block)
        many = lists[tokens]
        owner = np.repeat(np.repeat(np.arange(len(block)), [len(r) for r in block]), many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)  # within a token's list
        common = np.bincount(owner * n + holders[np.repeat(starts[tokens], many) + place], minlength=len(block) * n)
        pairs = np.flatnonzero(common)
        i, j = pairs // n + start + at, pairs % n
        other = i != j
        i, j, shared = i[other], j[other], common[pairs[other]]
        yield start + to, i.astype(np.int32), j.astype(np.int32), shared / (size[i] + size[j] - shared)
        at = to


def ranks(token_sets: list[set[str]]) -> np.ndarray:
    """Scores of sentences from their Jaccard similarities; rounds stop once scores barely
    change, with the scores before that change. Pairs with a common token are edges, counted from
    the tokens' lists of sentences and held as arrays, so a round is one weighted count."""
    n = len(token_sets)
    number: dict[str, int] = {}
    rows = [np.sort(np.fromiter((number.setdefault(t, len(number)) for t in sorted(tokens)), np.int64, len(tokens))) for tokens in token_sets]
    size = np.array([len(r) for r in rows], float)
    flat, owner = np.concatenate([np.zeros(0, np.int64), *rows]), np.repeat(np.arange(n), size.astype(np.int64))
    holders, starts = owner[np.argsort(flat, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(number)))])
    held, room, rest = [], HELD, 0
    for rest, i, j, value in _edges(rows, 0, holders, starts, size):
        held.append((i, j, value))
        room -= len(i)
        if room <= 0:
            break
    scores = np.ones(n) / n
    for _ in range(ROUNDS):
        fresh = np.full(n, (1 - DAMPING) / n)
        for i, j, value in held:
            fresh += DAMPING * np.bincount(i, value * scores[j], minlength=n)
        for _, i, j, value in _edges(rows, rest, holders, starts, size):
            fresh += DAMPING * np.bincount(i, value * scores[j], minlength=n)
        if np.allclose(scores, fresh, atol=1e-6):
            break
        scores = fresh
    return scores


_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # white space as the column functions have it
_WORDS = re.compile(_BLANK + "+")
_SIGNALS = [re.compile(p.replace(r"\s", _BLANK)) for p in vocab.LEGAL_PATTERNS]
_STOP = frozenset(vocab.STOPWORDS)
_DIGIT = re.compile("[0-9]")


def _bonus(sentence: str) -> float:
    """0.15 for each legal signal, 0.2 with a hint: none without a syllable and a digit."""
    if sentence.isascii() and not _DIGIT.search(sentence):
        return 0.0
    signals = sum(sum(1 for _ in p.finditer(sentence)) for p in _SIGNALS)
    return signals * 0.15 + (0.2 if any(h in sentence for h in vocab.TERM_HINTS) else 0.0)


def chosen(sentences: list[str], top: int) -> list[str]:
    """The best sentences in their order: a score is the rank plus the bonus; scores that agree to nine
    digits are ties, and go to the later one."""
    if len(sentences) <= top:
        return list(sentences)
    score = ranks([{w for w in _WORDS.split(s) if len(w) > 1 and w not in _STOP} for s in sentences]) + np.array([_bonus(s) for s in sentences])
    return [sentences[i] for i in sorted(np.argsort(np.round(np.log(score), 9), kind="stable")[-top:].tolist())]


def best_sentences(clean: Column, top: int) -> Column:
    """The best sentences of a normalised text, one a line: a function of one text, batch by batch."""

    @F.pandas_udf("string")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda sentences: "\n".join(chosen(sentences, top)))

    return best(X.sentences(clean))


def key_sentences(docs: DataFrame, doc: str, text: str, top: int) -> DataFrame:
    """(doc, sentences): the best sentences in the order of the document, one a line. A score
    is the rank plus 0.15 for each legal signal and 0.2 with a hint; ties go to the later
    sentence."""
    clean = docs.select(F.col(doc).alias("doc"), X.normalize_legal(F.col(text)).alias("clean"))
    return clean.select("doc", best_sentences(F.col("clean"), top).alias("sentences"))
