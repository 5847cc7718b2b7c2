"""Column functions for text: plain expressions that stay inside whole-stage code."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it may name many times: bound once, so that nested functions
    don't multiply the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # what (?U)\s matches
LINE_ENDS = ("\n", "\r", "\x85", "\u2028", "\u2029")  # in front of which $ matches at the end of a text


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends; looks at the ends alone."""
    return F.btrim(text, F.lit(WHITE_SPACE))


REACH = r"(?s)^(.*[가-힣][^A-Za-z]*+[^\n]*+).{0,100}"


def reach(text: Column) -> Column:
    """(lines, more): a text up to its last Hangul syllable, what follows without a Latin letter and the rest of that line; and this
    with a hundred characters more. A pattern that needs a syllable and goes on over no more than that finds here what it
    finds in the whole text; texts without a syllable give empty ones."""
    return let(F.regexp_extract(text, REACH, 0), lambda m: F.struct(F.regexp_extract(m, REACH, 1).alias("lines"), m.alias("more")))


def escape_like(value: str) -> str:
    """A string whose LIKE wildcards stand for themselves."""
    return re.sub(r"([\\%_])", r"\\\1", value or "")


def contains_any_case(column: Column, needle: str) -> Column:
    """Case-insensitive substring test; null columns don't contain anything."""
    return F.coalesce(F.contains(F.lower(column), F.lit(needle.lower())), F.lit(False))


def join_parts(*columns: Column, sep: str = " / ") -> Column:
    """The columns that are not blank, trimmed and joined."""
    parts = F.filter(F.array(*[F.trim(F.coalesce(c, F.lit(""))) for c in columns]), lambda p: p != "")
    return F.array_join(parts, sep)


def join_present(*columns: Column, sep: str = " ") -> Column:
    """The columns that are neither null nor empty, joined."""
    return F.concat_ws(sep, *[F.nullif(c, F.lit("")) for c in columns])


def normalize_legal(text: Column) -> Column:
    """Drops web addresses, puts bracketed section heads on their own line and collapses
    white space. Null gives the empty string."""
    out = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(out, r"(?U)https?://\S+", " ")
    out = F.regexp_replace(out, r"(?U)www\.\S+", " ")
    out = F.regexp_replace(out, r"(?U)portal\.scourt\.go\.kr\S*", " ")
    out = F.regexp_replace(out, r"(?U)\[\s*(판시사항|판결요지|참조조문|참조판례|전문|주문|원심판결|이유)\s*\]", "\n[$1]\n")
    out = F.regexp_replace(out, r"[\t\r\f\x0B]", " ")
    out = F.regexp_replace(out, r"\n{2,}", "\n")
    out = F.regexp_replace(out, r" {2,}", " ")
    return trimmed(out)


def tokenize(text: Column) -> Column:
    """White-space separated tokens of two characters or more that are no stop words."""
    words = F.split(F.coalesce(text, F.lit("")), r"(?U)\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*vocab.STOPWORDS))


def counted(tokens: Column) -> Column:
    """(term, n) of the distinct elements of an array in their order: sorted once, without a shuffle."""

    def of(rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda w, j: F.struct(w.alias("term"), j.alias("j"))), lambda x: (x["j"] == 0) | (F.get(rows, x["j"] - 1) != x["term"]))
        return let(starts, lambda s: F.transform(s, lambda x, k: F.struct(x["term"].alias("term"), (F.coalesce(F.get(s, k + 1)["j"], F.size(rows)) - x["j"]).cast("long").alias("n"))))

    return let(F.sort_array(tokens), of)


def strip_ending(word: Column) -> Column:
    """Cuts the longest listed ending off a word of three characters or more, if two
    characters at least remain."""
    endings = "|".join(sorted(set(vocab.ENDINGS), key=len, reverse=True))
    word = F.trim(word)
    last = {e[-1] for e in vocab.ENDINGS} | set(LINE_ENDS)  # others end in none
    return F.when((F.length(word) >= 3) & F.right(word, F.lit(1)).isin(*sorted(last)), F.regexp_replace(word, f"^(.{{2,}}?)(?:{endings})$", "$1")).otherwise(word)


def count_hints(text: Column, hints: list[str]) -> Column:
    """How many of the hints the text contains."""
    total = F.lit(0)
    for hint in hints:
        total = total + F.when(F.contains(text, F.lit(hint)), 1).otherwise(0)
    return total


def has_hint(text: Column, hints: list[str]) -> Column:
    out = F.lit(False)
    for hint in hints:
        out = out | F.contains(text, F.lit(hint))
    return out


def last_end(text: Column, endings: tuple[str, ...]) -> Column:
    """Where the last of the endings in a text stops (0: none)."""
    def end(e: str) -> Column:
        at = F.locate(e[::-1], F.reverse(text))
        return F.when(at > 0, F.length(text) - at + 1).otherwise(0)

    return F.greatest(*[end(e) for e in endings])


def smart_truncate(text: Column, limit: int) -> Column:
    """Collapses white space and shortens to ``limit``: after the last sentence ending, else
    at the last space, in either case not in the first third; else with an ellipsis."""
    least = max(20, limit // 3)

    def cut(clean: Column) -> Column:
        return F.when(F.length(clean) <= limit, clean).otherwise(let(F.substring(clean, 1, limit), shorten))

    def shorten(head: Column) -> Column:
        return let(F.struct(head.alias("head"), last_end(head, vocab.CUT_ENDINGS).alias("end"), (F.length(head) - F.locate(" ", F.reverse(head))).alias("space")), choose)

    def choose(x: Column) -> Column:
        return (
            F.when(x["end"] >= least, F.trim(F.left(x["head"], x["end"])))
            .when((x["space"] >= least) & (x["space"] < F.length(x["head"])), F.concat(F.rtrim(F.left(x["head"], x["space"])), F.lit("…")))
            .otherwise(F.concat(F.rtrim(x["head"]), F.lit("…")))
        )

    return let(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), cut)


def snippet(*parts: Column, limit: int = 220) -> Column:
    """The parts joined and shortened after a sentence ending, else with an ellipsis."""
    def cut(joined: Column) -> Column:
        head = F.substring(joined, 1, limit)
        shorter = let(
            F.struct(head.alias("head"), last_end(head, vocab.SNIPPET_ENDINGS).alias("end")),
            lambda x: F.when(x["end"] >= 40, F.trim(F.left(x["head"], x["end"]))).otherwise(F.concat(F.rtrim(x["head"]), F.lit("…"))),
        )
        return F.when(joined == "", F.lit(vocab.NO_SUMMARY)).when(F.length(joined) <= limit, joined).otherwise(shorter)

    return let(join_parts(*parts), cut)


def ensure_terminal(text: Column) -> Column:
    """Adds an ellipsis to a text that doesn't end as a sentence does."""
    ends = "(" + "|".join(map(re.escape, vocab.TERMINALS)) + ")$"
    return let(F.trim(F.coalesce(text, F.lit(""))), lambda clean: F.when((clean == "") | clean.rlike(ends), clean).otherwise(F.concat(clean, F.lit("…"))))


def preview(text: Column, words: int = 20) -> Column:
    """The first words and three dots."""
    return F.concat(F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, words), " "), F.lit("..."))


def quote_overlaps(quote: Column, snippets: Column, run: int = 8) -> Column:
    """Whether a snippet holds any ``run`` consecutive characters of the quote."""

    def test(clean: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(clean) - (run - 1))
        found = F.exists(starts, lambda i: F.exists(snippets, lambda s: F.contains(s, F.substring(clean, i, F.lit(run)))))
        return F.when(F.length(clean) < run, F.lit(False)).otherwise(F.coalesce(found, F.lit(False)))

    return let(F.trim(F.coalesce(quote, F.lit(""))), test)


def sentences(text: Column, least: int = 12) -> Column:
    """Sentences of a normalised text: split after Korean endings and full stops in front of
    Hangul, brackets or digits, and at line breaks; shorter ones than ``least`` are dropped."""
    split_at = (
        r"(?U)(?<=[다요죠음임])[.。]\s+(?=[가-힣\[\d])"
        r"|(?<=[다요죠음임])\s+(?=\[)"
        r"|(?<=[.!?])\s+(?=[가-힣\[\d])"
        r"|\n+"
    )
    parts = F.transform(F.split(text, split_at), trimmed)
    return F.filter(parts, lambda s: F.length(s) >= least)


SIGNALS = ("articles", "case_numbers", "dates", "courts")  # our names of the four legal patterns, in their order


def legal_signals(text: Column) -> Column:
    """Matches of each of the four legal patterns in a text: our definition of the signals that a
    summary should retain."""
    return F.struct(*(F.regexp_count(text, F.lit("(?U)" + p)).alias(name) for name, p in zip(SIGNALS, vocab.LEGAL_PATTERNS, strict=True)))


def count_legal_signals(text: Column) -> Column:
    """Matches of all four together."""
    return sum((F.regexp_count(text, F.lit("(?U)" + p)) for p in vocab.LEGAL_PATTERNS), F.lit(0))
