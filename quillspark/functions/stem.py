"""English words reduced by their endings: Porter's algorithm (1980)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values of the published algorithm: endings and what they become -------------------------
DOUBLE = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
SINGLE = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
DROPPED = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_PLAIN = re.compile("[a-z]{3,}")
KNOWN = 200_000  # distinct words that a task remembers


def _kinds(word: str) -> str:
    """v and c of each letter: y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _kinds(stem)[-1] == "c"


def _short(stem: str) -> bool:
    return _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, pairs: tuple[tuple[str, str], ...]) -> str:
    """The longest ending that fits, if something is left in front of it."""
    for ending, to in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + to if _measure(stem) > 0 else word
    return word


def _inflection(word: str) -> str:
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        stem = word[: -len(ending)]
        if word.endswith(ending) and "v" in _kinds(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _doubled(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short(stem) else stem
    return word


def porter(word: str) -> str:
    """The stem of a word of three or more letters a-z; others are their own."""
    if not _PLAIN.fullmatch(word):
        return word
    word = _inflection(word)
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, DOUBLE), SINGLE)
    for ending in sorted(DROPPED, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            if _measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stems(words: Column) -> Column:
    """The stems of an array of words in lower case, batch by batch; a distinct word is reduced once."""

    @F.pandas_udf("array<string>")
    def reduced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}

        def of(ws) -> list[str]:
            for w in ws:
                if w not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[w] = porter(w)
                yield known[w]

        for b in batches:
            yield b.map(lambda ws: None if ws is None else list(of(ws)))

    return reduced(words)
