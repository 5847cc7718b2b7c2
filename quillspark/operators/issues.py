"""Issue detection and expansion, categories, weak keywords, and search by weighted tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.issues import CATEGORIES, ISSUES, NO_CATEGORY
from ..functions.patterns import scan

KEYWORDS = [k for k, *_ in ISSUES]


def _words(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def direct_issues(text: Column) -> Column:
    """Issues whose keyword the text contains, in the order of the dictionary."""
    return F.filter(_words(KEYWORDS), lambda k: F.contains(F.coalesce(text, F.lit("")), k))


def named(found: Column) -> Column:
    """The issues of numbers in the dictionary that were found, in its order."""
    return F.transform(found, lambda n: F.get(_words(KEYWORDS), n))


def related_issues(direct: Column) -> Column:
    """Keywords one step from the direct ones that aren't direct themselves, each once, in
    the order of the dictionary and of its lists."""
    steps = F.create_map(*[x for k, _, related, _ in ISSUES for x in (F.lit(k), _words(related))])
    return F.array_except(F.array_distinct(F.flatten(F.transform(direct, lambda d: steps[d]))), direct)


def category(keywords: Column) -> Column:
    """The category of the largest summed importance; of equals the first in priority."""
    importance = lambda name: F.create_map(*[x for k, c, _, w in ISSUES for x in (F.lit(k), F.lit(w if c == name else 0))])
    total = lambda name: F.aggregate(keywords, F.lit(0), lambda s, k: s + F.coalesce(F.try_element_at(importance(name), k), F.lit(0)))
    sums = F.array(*[total(c) for c in CATEGORIES])
    pick = F.transform(F.array(sums), lambda s: F.when(F.array_max(s) > 0, F.get(_words(CATEGORIES), F.array_position(s, F.array_max(s)) - 1)).otherwise(F.lit(NO_CATEGORY)))
    return F.get(pick, F.lit(0))


def weak_keywords(records: DataFrame, text: Column, k: int) -> DataFrame:
    """Issues by the number of records that mention them: a record counts an issue once."""
    found = records.select(F.explode(named(scan(text, KEYWORDS))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def weighted_search(rows: DataFrame, query: str, title: Column, subject: Column, body: Column, key: str, k: int) -> DataFrame:
    """Rows by a sum of substring hits: the whole query in title (5) or body (2), each of its
    words and the issues it touches in title (3), subject (2) or body (1). A blank query
    gives the first rows by key; otherwise only rows above 0, of equals the smaller key."""
    query = query.strip()
    if not query:
        return rows.orderBy(key).limit(k).withColumn("score", F.lit(0.0))
    direct = [i for i in KEYWORDS if i in query]
    related = [r for i, _, rs, _ in ISSUES if i in direct for r in rs]
    tokens = sorted({t.lower() for t in [*query.split(), *direct, *related] if len(t) >= 2})
    title, subject, body = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, subject, body))

    def hit(column: Column, needle: str, weight: float) -> Column:
        return F.when(F.contains(column, F.lit(needle)), weight).otherwise(0.0)

    score = hit(title, query.lower(), 5.0) + hit(body, query.lower(), 2.0)
    for t in tokens:
        score = score + hit(title, t, 3.0) + hit(subject, t, 2.0) + hit(body, t, 1.0)
    return rows.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), key).limit(k)
