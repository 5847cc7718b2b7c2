"""Rule scorers: study domains, keyphrases, study focus."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab
from ..functions.patterns import Has, contains_in, scan, scanned_in
from ..functions.taxonomy import SUBJECT_HINTS, TAXONOMY, WEIGHTS
from . import issues


DOMAIN_WORDS = list(dict.fromkeys(h for hints in vocab.DOMAIN_HINTS.values() for h in hints))


def domain_corpus(text: Column, keywords: Column | None = None) -> Column:
    """What hints of domains are looked for in: the normalised text and the keywords in lower case."""
    words = F.array_join(keywords, " ") if keywords is not None else F.lit("")
    return X.let(X.normalize_legal(text), lambda clean: F.lower(F.concat(clean, F.lit(" "), words)))


def domain_of(has: Has) -> Column:
    """The domain with the most hints; of equals the first in priority; below two hints the general one."""
    names = F.array(*map(F.lit, vocab.DOMAIN_HINTS))
    scores = F.array(*[sum((F.when(has(h), 1).otherwise(0) for h in hints), F.lit(0)) for hints in vocab.DOMAIN_HINTS.values()])
    return X.let(scores, lambda s: F.when(F.array_max(s) < 2, F.lit(vocab.GENERAL_DOMAIN)).otherwise(F.get(names, F.array_position(s, F.array_max(s)) - 1)))


def study_domain(text: Column, keywords: Column | None = None) -> Column:
    """The domain of a text and its keywords, a search for each hint."""
    return X.let(domain_corpus(text, keywords), lambda corpus: domain_of(contains_in(corpus)))


def study_focus(domain: Column, keywords: Column, key_sentences: Column) -> Column:
    """Three lines of advice for a domain."""
    named = F.when(F.size(keywords) > 0, F.array_join(F.slice(keywords, 1, 4), ", ")).otherwise(F.lit(vocab.NO_KEYWORDS))
    first = F.trim(F.split(F.coalesce(key_sentences, F.lit("")), "\n")[0])
    first = F.substring(F.when(first == "", F.lit(vocab.NO_SENTENCE)).otherwise(first), 1, 90)

    def line(pattern: str) -> Column:
        return F.replace(F.replace(F.lit(pattern), F.lit("{0}"), first), F.lit("{1}"), named)

    out = F
    for name, lines in vocab.STUDY_FOCUS.items():
        if name != vocab.GENERAL_DOMAIN:
            out = out.when(domain == name, F.array(*map(line, lines)))
    return out.otherwise(F.array(*map(line, vocab.STUDY_FOCUS[vocab.GENERAL_DOMAIN])))


def legal_hits(text: Column) -> Column:
    """Statutes, case numbers, dates and courts of a normalised text, without white space: by
    pattern, then by place, each once."""
    found = [F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0)) for p in vocab.LEGAL_PATTERNS]
    return F.array_distinct(F.transform(F.concat(*found), lambda m: F.regexp_replace(m, r"(?U)\s+", "")))


_HANGUL = re.compile("[가-힣]{2,14}")
_ENDING = re.compile("^(.{2,}?)(?:" + "|".join(sorted(set(vocab.ENDINGS), key=len, reverse=True)) + ")$")
_STOP = frozenset(vocab.STOPWORDS)


def term_score(term: Column, n: Column) -> Column:
    """Occurrences, +1.8 with a hint inside, +1.0 with a legal ending, -0.5 with a verb rest."""
    ends = lambda endings: term.rlike("(?:" + "|".join(map(re.escape, endings)) + ")$")
    return (
        n.cast("double")
        + F.when(X.has_hint(term, vocab.TERM_HINTS), 1.8).otherwise(0.0)
        + F.when(ends(vocab.LEGAL_SUFFIXES), 1.0).otherwise(0.0)
        - F.when(ends(vocab.VERB_RESTS), 0.5).otherwise(0.0)
    )


def score_of(term: str, n: int) -> float:
    """As ``term_score``, for a term at hand."""
    hint, legal, verb = any(h in term for h in vocab.TERM_HINTS), term.endswith(vocab.LEGAL_SUFFIXES), term.endswith(vocab.VERB_RESTS)
    return n + 1.8 * hint + 1.0 * legal - 0.5 * verb


def ranked_terms(clean: str, k: int) -> list[str]:
    """Hangul words of 2 to 14 characters without their endings, by score and then by first occurrence."""
    found = (_ENDING.sub(r"\1", w) if len(w) >= 3 else w for w in _HANGUL.findall(clean))
    counts = Counter(w for w in found if 2 <= len(w) <= 14 and w not in _STOP)  # in order of first occurrence
    return [w for _, _, w in nsmallest(k, ((-score_of(w, n), place, w) for place, (w, n) in enumerate(counts.items())))]


def phrases(clean: Column, k: int) -> Column:
    """The keyphrases of a normalised text: first the legal hits, then ranked terms; ``k`` at most, each once.
    A function of one text: words are counted where the text is, batch by batch."""

    @F.pandas_udf("array<string>")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: ranked_terms(t, 2 * k))

    hits = F.filter(legal_hits(clean), lambda h: F.length(h) > 1)
    return F.slice(F.array_distinct(F.concat(hits, terms(clean))), 1, k)


def keyphrases(docs: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    """(doc, phrases) of each document."""
    clean = docs.select(F.col(doc).alias("doc"), X.normalize_legal(F.col(text)).alias("clean"))
    return clean.select("doc", phrases(F.col("clean"), k).alias("phrases"))


# ---- weighted classification -------------------------------------------------------------------
CLASS_WORDS = list(dict.fromkeys(h for hints in WEIGHTS.values() for h in hints))


def class_corpus(text: Column, keywords: Column | None = None) -> Column:
    """What hints of classes are looked for in: text and keywords without forms like "in the constitution's
    sense", which don't count for constitutional law."""
    words = F.array_join(keywords, " ") if keywords is not None else F.lit("")
    corpus = F.concat(F.coalesce(text, F.lit("")), F.lit(" "), words)
    corpus = F.regexp_replace(F.regexp_replace(corpus, "헌법재판소", "\u0001"), "헌법상|헌법적", " ")
    return F.regexp_replace(corpus, "\u0001", "헌법재판소")


def criminal_code(corpus: Column) -> Column:
    """Whether the criminal code counts: where the code of criminal procedure is named, only in front of
    an article, a general or a special part."""
    return corpus.rlike("형법(제|상|총칙|각칙)") | ~F.contains(corpus, F.lit("형사소송법"))


def class_of(has: Has, special: Column) -> Column:
    return best_class(has, WEIGHTS, {"형법": special})


def study_class(text: Column, keywords: Column | None = None) -> Column:
    """The weighted class of a text and its keywords, a search for each hint."""
    parts = X.let(class_corpus(text, keywords), lambda corpus: F.struct(corpus.alias("text"), criminal_code(corpus).alias("special")))
    return X.let(parts, lambda x: class_of(contains_in(x["text"]), x["special"]))


def weighted_class(text: Column, weights: dict[str, dict[str, float]], only_if: dict[str, Column] | None = None) -> Column:
    """``best_class`` of the hints that a text contains."""
    return best_class(contains_in(text), weights, only_if)


def best_class(has: Has, weights: dict[str, dict[str, float]], only_if: dict[str, Column] | None = None) -> Column:
    """Class of the largest sum of weights of the hints that are there, with the confidence
    best / (best + second + 0.1) and the runner-up where that is below 0.7; below a sum of
    2 the general class. Ties go to the name first in the alphabet. Hints in ``only_if``
    also need their condition."""
    rows = []
    for name in sorted(weights):
        total = F.lit(0.0)
        for hint, w in weights[name].items():
            total = total + F.when(has(hint) & (only_if or {}).get(hint, F.lit(True)), float(w)).otherwise(0.0)
        rows.append(F.struct((-total).alias("minus"), F.lit(name).alias("name")))
    ranked = F.array_sort(F.array(*rows))

    def read(r: Column) -> Column:
        best, second = -r[0]["minus"], -F.coalesce(F.get(r, F.lit(1))["minus"], F.lit(0.0))
        sure = best / (best + second + 0.1)
        return F.struct(
            F.when(best < 2, F.lit("general")).otherwise(r[0]["name"]).alias("name"),
            F.when(best < 2, F.lit(0.0)).otherwise(sure).alias("confidence"),
            F.when((best >= 2) & (sure < 0.7), F.get(r, F.lit(1))["name"]).alias("runner_up"),
        )

    return F.get(F.transform(F.array(ranked), read), F.lit(0))


# ---- all dictionaries at once -----------------------------------------------------------------------
def labelled(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, domain, class, direct) of each text: study domain, weighted class and direct issues, each as by its own
    function. Every dictionary is one automaton, and a text goes through each once, in one batch of the three."""
    t = F.col(text)
    corpora = docs.select(F.col(doc).alias("doc"), domain_corpus(t).alias("d"), class_corpus(t).alias("c"), t.alias("i"))
    special = criminal_code(F.col("c"))
    found = corpora.select("doc", special.alias("special"), scan(F.col("d"), DOMAIN_WORDS).alias("d"), scan(F.col("c"), CLASS_WORDS).alias("c"), scan(F.col("i"), issues.KEYWORDS).alias("i"))
    return found.select(
        "doc", domain_of(scanned_in(F.col("d"), DOMAIN_WORDS)).alias("domain"), class_of(scanned_in(F.col("c"), CLASS_WORDS), F.col("special")).alias("class"),
        issues.named(F.col("i")).alias("direct"),
    )


# ---- taxonomy --------------------------------------------------------------------------------------
def _best_label(text: Column, labels: list[str]) -> Column:
    """The label with the most signs in the text: 2 for itself, 1 for its first two characters;
    of equals the first; empty without a sign."""
    score = lambda x: F.when(F.contains(text, F.lit(x)), 2).otherwise(0) + F.when(F.contains(text, F.lit(x[:2])), 1).otherwise(0)
    scores = F.array(*map(score, labels))
    return X.let(scores, lambda s: F.when(F.array_max(s) > 0, F.get(F.array(*map(F.lit, labels)), F.array_position(s, F.array_max(s)) - 1)).otherwise(F.lit("")))


def _lower(text: Column, subject: str, tree: dict[str, list[str]]) -> Column:
    """The path from a subject down."""

    def down(category: Column) -> Column:
        out = F.when(category == "", F.lit(subject))
        for name, leaves in tree.items():
            out = out.when(category == name, F.concat_ws(" > ", F.lit(subject), F.lit(name), F.nullif(_best_label(text, leaves), F.lit(""))))
        return out

    return X.let(_best_label(text, list(tree)), down)


def taxonomy_path(text: Column) -> Column:
    """subject > category > leaf of the first 220 characters, as far down as there are signs; empty
    for texts below 8 characters or without a subject."""

    def path(t: Column) -> Column:
        out = F.when(F.length(t) < 8, F.lit(""))
        for subject, hints in SUBJECT_HINTS.items():
            out = out.when(X.has_hint(t, hints), _lower(t, subject, TAXONOMY[subject]))
        return out.otherwise(F.lit(""))

    return X.let(F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, 220), path)
