"""Many words at once: one automaton over a dictionary, one pass over each text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Has = Callable[[str], Column]  # whether a text contains a word of the dictionary


def contains_in(text: Column) -> Has:
    """A search of its own for each word."""
    return lambda word: F.contains(text, F.lit(word))


def scan(text: Column, words: Sequence[str]) -> Column:
    """The numbers of the words that a text contains, ascending, each once. Null and empty texts have none.
    The automaton is made once in a task; batches of texts go through it."""
    words = list(words)

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, word in enumerate(words):
            automaton.add_word(word, number)
        automaton.make_automaton()
        for texts in batches:
            yield texts.map(lambda t: sorted({n for _, n in automaton.iter(t)}) if t else [])

    return found(text)


def scanned_in(found: Column, words: Sequence[str]) -> Has:
    """The same answers from the numbers that ``scan`` has found."""
    number = {word: n for n, word in enumerate(words)}
    return lambda word: F.array_contains(found, F.lit(number[word]))
