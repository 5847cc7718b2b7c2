"""Checks of answers against the evidence they cite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import quote_overlaps
from ..functions.vocab import GROUNDING_RULES


def violations(answer: Column, cited: Column, retrieved: Column, quotes: Column, snippets: Column) -> Column:
    """Names of the rules that an answer breaks, in a fixed order: no citation; a citation
    that was not retrieved; "unknown" without "insufficient"; a quote that no snippet has."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    some = F.size(cited) > 0
    unmatched = F.exists(quotes, lambda q: (q != "") & ~quote_overlaps(q, snippets))
    tests = (
        ~some,
        some & (F.size(F.array_except(cited, retrieved)) > 0),
        F.contains(low, F.lit("unknown")) & ~F.contains(low, F.lit("insufficient")),
        (F.size(quotes) > 0) & (F.size(snippets) > 0) & F.coalesce(unmatched, F.lit(False)),
    )
    return F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in zip(tests, GROUNDING_RULES, strict=True)]), lambda n: n.isNotNull())
