"""Structure of pasted judgments: sections, issues, opinions, statutes, precedents.

Sections are cut at their markers by two expressions, one for the markers and one for what is
between them; all else are expressions over these arrays.
"""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statements import any_of, squeeze, strip
from ..functions.text import let, reach

# --- fixed values: names of sections, brackets around them, names of acts --------------------
SECTIONS = (
    "판시사항", "판결요지", "결정요지", "요지", "참조조문", "참조판례", "판결내용", "상세내용", "사건", "전문", "피고인", "상고인", "원심판결", "주문", "이유",
)
SPACED = {"요지", "판결내용", "상세내용", "사건", "전문", "피고인", "상고인", "주문", "이유"}  # may be written with spaces
BRACKETS = ("【】", "[]", "〔〕", "<>")
ACTS = (
    "헌법", "형법", "형사소송법", "민법", "민사소송법", "상법", "부가가치세법", "법인세법", "국세기본법", "행정소송법", "행정심판법",
    "행정절차법", "국가공무원법", "지방공무원법", "경찰관 직무집행법", "경찰법", "특정범죄가중처벌등에관한법률",
    "특정경제범죄가중처벌등에관한법률", "도로교통법", "정보통신망 이용촉진 및 정보보호 등에 관한 법률", "공직선거법", "국가보안법",
    "변호사법", "새마을금고법", "성폭력범죄의 처벌 등에 관한 특례법", "성폭력범죄의처벌등에관한특례법", "성폭력처벌법",
    "아동·청소년의 성보호에 관한 법률", "아동청소년의 성보호에 관한 법률", "청소년성보호법", "마약류 관리에 관한 법률",
    "마약류관리에관한법률", "스토킹범죄의 처벌 등에 관한 법률", "교통사고처리 특례법", "폭력행위 등 처벌에 관한 법률", "개인정보 보호법",
)
PRECEDENT = r"\d{2,4}\s*(?:도|다|두|므|허|초|카|모|러|마|헌마|헌가|헌나|헌바|전도)\d+"
OPINIONS = (("다수의견", "majority"), ("반대의견", "dissent"), ("보충의견", "concurring"), ("별개의견", "separate"))
POLARITIES = (
    ("(한정 적극)", "limited_positive"), ("(한정적극)", "limited_positive"), ("(한정 소극)", "limited_negative"),
    ("(한정소극)", "limited_negative"), ("(적극)", "positive"), ("(소극)", "negative"),
)

_NAME = "|".join(r"\s*".join(s) if s in SPACED else s for s in sorted(SECTIONS, key=len, reverse=True))
MARKER = "|".join([*(rf"{re.escape(a)}\s*(?:{_NAME})\s*{re.escape(b)}" for a, b in BRACKETS), rf"(?:^|\n)\s*(?:{_NAME})\s*[:：]?\s*(?=\n)"])
OPINION = r"\[\s*([^\]]*?(?:다수의견|반대의견|보충의견|별개의견))\s*\]"


def first_of(text: Column, table, otherwise: str) -> Column:
    out = F
    for mark, name in table:
        out = out.when(F.contains(text, F.lit(mark)), name)
    return out.otherwise(otherwise)


def found_or(items: Column, otherwise: Column) -> Column:
    """The items that are not empty, or else one other."""
    return let(F.filter(items, lambda i: i != ""), lambda some: F.when(F.size(some) > 0, some).otherwise(F.array(otherwise)))


def after_first(text: Column, pattern: str) -> Column:
    """What comes after each match of a pattern."""
    return let(F.split(text, pattern, -1), lambda parts: F.slice(parts, F.lit(2), F.size(parts)))


def sections(text: Column) -> Column:
    """(name, body, place) of every section in order. Markers are looked for as far as there is Hangul; what comes after that belongs
    to the last section."""

    def found(head: Column) -> Column:
        names = F.transform(F.regexp_extract_all(head, F.lit("(?U)" + MARKER), F.lit(0)), lambda m: F.regexp_replace(m, r"(?U)[\s:：【】\[\]〔〕<>]", ""))
        return F.struct(F.arrays_zip(names.alias("name"), after_first(head, "(?U)" + MARKER).alias("body")).alias("pairs"), F.length(head).alias("n"))

    def whole(x: Column) -> Column:
        body = lambda p, at: F.when(at == F.size(x["pairs"]) - 1, F.concat(p["body"], F.substr(text, x["n"] + 1))).otherwise(p["body"])
        return F.transform(x["pairs"], lambda p, at: F.struct(p["name"].alias("name"), body(p, at).alias("body"), at.alias("place")))

    return let(let(reach(text)["lines"], found), whole)


def section(found: Column, name: str) -> Column:
    """The body of a section; of repeated ones the longest, of equals the first; null if there is none."""
    mine = F.transform(F.filter(found, lambda s: s["name"] == name), lambda s: F.struct((-F.length(s["body"])).alias("minus"), s["place"].alias("place"), s["body"].alias("body")))
    return F.get(F.array_sort(mine), F.lit(0))["body"]


def numbered(body: Column) -> Column:
    """Items after [1], [2], ...; the whole body if there are none."""
    return found_or(F.transform(after_first(body, r"(?U)\[\s*\d+\s*\]"), strip), body)


def clauses(issue: Column) -> Column:
    """Sub-issues between slashes that stand between Hangul (or a closing bracket) and Hangul;
    parts of six characters or more, or the whole issue."""
    parts = F.transform(F.split(issue, r"(?U)(?<=[가-힣)])\s*/\s*(?=[가-힣])", -1), strip)
    return let(F.filter(parts, lambda p: F.length(p) >= 6), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.array(issue)))


def digest_issues(body: Column) -> Column:
    """(text, polarity) of the issues of a bulleted digest: of question and answer the answer."""

    def issue(item: Column) -> Column:
        text = F.regexp_replace(squeeze(item), r"(?U)^\(?\s*쟁점\s*[①-⑩0-9]+\s*\)?\s*", "")
        parts = let(F.split(text, r"(?U)\s*[-–—]\s*", 2), lambda p: F.struct(p[0].alias("question"), strip(F.get(p, F.lit(1))).alias("answer")))

        def chosen(p: Column) -> Column:
            asked, told = (first_of(p[c], POLARITIES, "unknown") for c in ("question", "answer"))
            return F.struct(F.when(p["answer"] != "", p["answer"]).otherwise(strip(p["question"])).alias("text"), F.when(asked != "unknown", asked).otherwise(told).alias("polarity"))

        return let(parts, chosen)

    items = F.filter(after_first(body, r"(?Udm)^\s*○\s*"), lambda p: strip(p) != "")
    return F.filter(F.transform(let(items, lambda some: F.when(F.size(some) > 0, some).otherwise(F.array(body))), issue), lambda i: F.length(i["text"]) >= 8)


def listed_issues(body: Column) -> Column:
    """(text, polarity) of numbered issues, cut into their clauses."""
    cut = F.flatten(F.transform(numbered(body), lambda item: clauses(squeeze(item))))
    return F.transform(cut, lambda c: F.struct(c.alias("text"), first_of(c, POLARITIES, "unknown").alias("polarity")))


def holdings(body: Column) -> Column:
    """(issue_no, opinion, text): numbered items, each cut at its opinions."""

    def of(item: Column, at: Column) -> Column:
        number = (at + 1).cast("int")
        told = lambda opinion, text: F.struct(number.alias("issue_no"), opinion.alias("opinion"), squeeze(text).alias("text"))
        labels = F.regexp_extract_all(item, F.lit("(?U)" + OPINION), F.lit(1))
        pairs = F.arrays_zip(labels.alias("label"), after_first(item, "(?U)" + OPINION).alias("text"))
        opinions = F.filter(F.transform(pairs, lambda p: told(first_of(p["label"], OPINIONS, "unspecified"), p["text"])), lambda h: h["text"] != "")
        return F.when(F.size(labels) > 0, opinions).otherwise(F.array(told(F.lit("unspecified"), item)))

    return F.flatten(F.transform(numbered(body), of))


def acts(text: Column) -> Column:
    """Known acts in a text, compared without white space, longer names first."""
    known = F.array(*map(F.lit, sorted(ACTS, key=len, reverse=True)))
    return let(F.regexp_replace(text, r"(?U)\s+", ""), lambda bare: F.filter(known, lambda a: F.contains(bare, F.replace(a, F.lit(" "), F.lit("")))))


def parse_judgments(docs: DataFrame, doc: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(doc, structure): a document in which no section is found has empty lists. The columns ``keep`` of a
    document stay beside its structure, so that nobody needs to join them again."""
    cut = docs.select(doc, *keep, sections(F.coalesce(F.col(text), F.lit(""))).alias("found"))
    names = {"asked": "판시사항", "digest": "요지", "held": "판결요지", "decided": "결정요지", "laws": "참조조문", "cases": "참조판례"}
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    parts = cut.select(doc, *keep, F.exists("found", lambda s: s["name"] == "이유").alias("has_reasoning"), *(section(F.col("found"), n).alias(c) for c, n in names.items()))
    no_issue, no_holding = (F.array().cast(t) for t in ("array<struct<text:string,polarity:string>>", "array<struct<issue_no:int,opinion:string,text:string>>"))
    ruled = F.coalesce(F.nullif("held", F.lit("")), F.nullif("decided", F.lit("")))
    made = parts.select(
        doc, *keep, "has_reasoning", squeeze(F.col("laws")).alias("statutes"),
        F.when(filled("asked"), listed_issues(F.col("asked"))).when(filled("digest"), digest_issues(F.col("digest"))).otherwise(no_issue).alias("issues"),
        F.when(ruled.isNotNull(), holdings(ruled)).otherwise(no_holding).alias("holdings"),
        F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("cases", F.lit("")), F.lit("(?U)" + PRECEDENT), F.lit(0)), lambda m: F.replace(m, F.lit(" "), F.lit("")))).alias("precedents"),
    )
    return made.select(
        doc, *keep, F.col("issues.text").alias("issues"), F.col("issues.polarity").alias("polarities"), "holdings", "statutes", acts(F.col("statutes")).alias("acts"), "precedents", "has_reasoning",
        F.exists("holdings", lambda h: h["opinion"] != "unspecified").alias("has_opinions"),
    )
