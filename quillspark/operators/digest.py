"""Case digests of parsed judgments: roles of sentences, the issue and the conclusion to show,
subjects, names, dispositions, domains; and records as rows of a search or of a screen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import statements as S
from ..functions import text as X
from ..functions import vocab
from . import classify
from .device import NAMED_IN_TEXT, domain_of_acts, domain_of_laws, first_sentence, majority, words_of

# --- fixed values: endings of conclusions ---------------------------------------------------------
CONCLUSIONS = (
    "한다.", "기각한다.", "파기한다.", "파기환송한다.", "파기자판한다.", "충족한다.", "해당한다.", "성립한다.", "인정된다.", "위법하다.", "정당하다.",
    "법리오해의 잘못이 있다.", "잘못이 있다.", "한 사례.", "사례.", "해당하지 아니한다.", "성립하지 아니한다.", "위법하지 않다.", "타당하다.",
    "허용되지 아니한다.", "허용된다.", "적법하다.", "위반된다.", "적용된다.", "있다.", "없다.", "된다.", "않는다.",
)
# --- fixed values: marks of scenarios, principles and holdings, one point each -------------------------
SCENARIO = ("사안에서", "사건에서", "피고인", "원고", "갑", "을", "기소된", "송금메모", "전송", "입금", "메시지", "이 사건", "구체적", "당해")
PRINCIPLE = ("의미", "보호법익", "요건", "취지", "해당한다", "성립한다", "적용된다", "권리", "법익")
HOLDING = ("구성요건", "법리오해", "잘못이 있다", "해당하여", "해당한다", "인정된다", "위법하다", "정당하다", "기각한다", "파기", "환송", "사안에서", "사건에서")
# --- fixed values: topics that an issue to show gains or loses by ------------------------------------------
TOPIC_POINTS = (("공범인 공동피고인", 6), ("증인이 될 수", 5), ("증인적격", 4), ("소송절차의 분리", 3), ("위증죄의 주체", 1))
# --- fixed values: parties and section names that are no subject -----------------------------------------------
PARTIES = ("피고인", "원고", "피고", "상고인", "피상고인", "항고인", "피항고인", "채무자", "채권자", "신청인", "청구인", "상대방")
LABELS = ("판시사항", "판결요지", "결정요지", "참조조문", "참조판례", "전문", "다수의견", "반대의견", "보충의견", "별개의견", *PARTIES)
NO_NAMES = (*PARTIES, "갑", "을", "병", "정", "해당", "판단", "부분", "내용", "사실", "법리", "문장")
SOURCE_WORDS = ("판례", "사건", "공보", "미간행", "선고", "판결", "결정", "원심", "상고", "항소")
# --- fixed values: marks of issue sentences and of verdicts, in tiers -------------------------------------------
STRONG_ISSUE = ("되는지", "할 수 있는지", "허용되는지", "해당하는지", "문제 된 사건", "문제된 사건", "증인이 될 수", "증인적격")
WEAK_ISSUE = ("기준", "판단 기준", "판단", "쟁점")
VERDICT_WORDS = (
    "포함되지 않는다", "포함된다", "해당하지 않는다", "해당한다", "위법하다", "적법하다", "유죄", "무죄", "기각한다", "기각", "인용한다", "인용", "위반된다", "위반",
    "위반되지 않는다", "허용되지 않는다", "허용된다", "위헌", "합헌", "한정위헌", "헌법불합치", "파기한다", "파기환송", "환송한다", "원심을 파기", "원심을 유지",
    "성립하지 않는다", "성립한다", "인정되지 않는다", "인정된다", "정당하다", "부당하다",
)
SENTENCE_HEADS = ("게 ", "고 ", "지 ", "서 ", "며 ", "어 ", "아 ", "워 ", "다 ", "라 ", "나 ", "는 ", "은 ", "이 ", "가 ", "을 ", "를 ", "의 ", "에 ", "도 ", "와 ", "과 ")
MORE_SPACED = (("있 는", "있는"), ("없 는", "없는"), ("였 다", "였다"), ("이 라", "이라"), ("담보하 는", "담보하는"), ("관 한", "관한"), ("대 한", "대한"))
DISPLAY_ENDINGS = ("다.", "다 ", "요.", "다고 한다.", "였다.", "한다.", "된다.", "이다.")
# --- fixed values: what the scan fallback counts ------------------------------------------------------------------
SCAN_HINTS = (
    "위법", "적법", "고의", "과실", "구성요건", "책임", "정당방위", "영장", "압수", "수색", "증거", "공소", "기소", "무죄", "유죄", "체포", "구속", "위헌", "합헌",
    "기본권", "과잉금지", "최소침해", "위원회", "징계", "행정처분", "취소", "재량", "처분", "결정", "판결",
)
SCAN_SUFFIXES = ("죄", "조", "법", "권", "처분", "결정")
COURTS = "대법원|헌법재판소|고등법원|지방법원|행정법원|가정법원|특허법원"
# --- fixed values: notices where nothing was found ----------------------------------------------------------------------
ISSUE_NOTICE = "판시사항 [1] 핵심 문장을 완전한 평서문으로 복원하지 못했습니다. 판시사항 첫 부분이 보이도록 다시 촬영하거나 붙여넣으면 쟁점 카드와 OX가 더 정확해집니다."
HOLDING_NOTICE = "판결요지(다수의견) 본문이 입력에 포함되지 않아 결론을 자동 추출하지 못했습니다. 원문에서 【판결요지】 단락을 함께 붙여넣으면 결론 카드가 채워집니다."
SPECIAL_LAWS = tuple(x for x in NAMED_IN_TEXT[0][1] if x != "형법")


def points(text: Column, marks) -> Column:
    return sum((F.when(F.contains(text, F.lit(m)), 1).otherwise(0) for m in marks), F.lit(0))


def best_of(rows: Column) -> Column:
    """The value of the row (score, value) of the largest score, of equals the first; null if none."""
    order = F.array_sort(F.transform(rows, lambda r, i: F.struct((-r["score"]).alias("minus"), i.alias("i"), r["value"].alias("value"))))
    return F.get(order, F.lit(0))["value"]


# ---- sentences -----------------------------------------------------------------------------------------
def cut_sentences(text: str) -> list[str]:
    """Sentences that end in a full stop outside of quotes, ten characters long at least."""
    out, start, quoted = [], 0, False
    text = text.strip()
    for i, c in enumerate(text):
        if c in S.QUOTES:
            quoted = not quoted
        elif c == "." and not quoted and len(text[start : i + 1].strip()) >= 10:
            out.append(text[start : i + 1].strip())
            start = i + 1
    rest = text[start:].strip()
    return [*out, rest] if rest else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentence_list(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.fillna("").map(cut_sentences)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def sentence_lists(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Of an array of texts, the sentences of each."""
    for t in texts:
        yield t.map(lambda xs: [] if xs is None else [cut_sentences(x or "") for x in xs])


def clamp(text: Column, limit: int) -> Column:
    """A sentence without pronouns: with its full stop, or cut with an ellipsis."""
    return X.let(S.resolve_pronouns(text), lambda t: F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("…"))).when(t.endswith("."), t).otherwise(F.concat(t, F.lit("."))))


def conclusion(text: Column, sentences: Column, limit: int = 220) -> Column:
    """The last sentence with the ending of a conclusion, else a plain last one, else the first."""
    last = F.get(sentences, F.size(sentences) - 1)
    strong = F.get(F.reverse(F.filter(sentences, lambda s: S.ends_with(s, CONCLUSIONS))), F.lit(0))
    return X.let(F.coalesce(strong, F.when(S.ends_with(last, (".", "다")), last)), lambda s: F.when(s.isNotNull(), clamp(s, limit)).otherwise(first_sentence(text, limit)))


def is_scenario(text: Column) -> Column:
    return points(S.squeeze(text), SCENARIO) >= 2


def case_conclusion(issue: Column) -> Column:
    """The conclusion of an issue that tells a case; null for others."""

    def of(t: Column) -> Column:
        rest = S.strip(F.coalesce(F.nullif(F.regexp_extract(t, "(?s)^.*?사안에서[, ](.*)$", 1), F.lit("")), t))
        full = F.when(rest.endswith("."), rest).otherwise(F.concat(rest, F.lit(".")))
        return F.when(S.ends_with(t, ("사례", "사례.")) & (F.length(full) >= 20), S.resolve_pronouns(full))

    return X.let(S.strip(issue), of)


def question_form(issue: Column) -> Column:
    """An issue as a question without its polarity; empty for one that tells a case."""

    def of(t: Column) -> Column:
        bare = S.strip(F.regexp_replace(F.regexp_replace(t, r"(?U)\s*\(\s*(한정\s*)?(적극|소극)\s*\)\s*", ""), "^(위 )?(및 )?", ""))
        told = S.any_of(t, ("사안에서", "사건에서")) | S.ends_with(t, ("사례", "사례."))
        return F.when(told, F.lit("")).otherwise(S.resolve_pronouns(F.regexp_replace(bare, r"\.$", "")))

    return X.let(S.squeeze(issue), of)


def quoted_terms(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?U)[{S.QUOTES}]([가-힣A-Za-z0-9·\\s]{{2,24}})[{S.QUOTES}]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, S.strip), lambda t: F.length(t) >= 2))


def sentence_roles(parsed: DataFrame, doc: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(doc, issues, principles, holdings, summaries): candidates of each role, the likeliest
    first for issues, in their order for the others, each once. The columns ``keep`` stay beside them."""
    held = majority(F.col("holdings"))
    rows = parsed.select(doc, *keep, text, "issues", "polarities", F.transform(held, lambda h: F.struct(h["issue_no"].alias("no"), h["text"].alias("text"))).alias("held"))
    rows = rows.withColumn("terms", quoted_terms(F.array_join("issues", " ")))
    rows = rows.withColumns({"cuts": sentence_lists(F.col("held.text")), "whole": sentence_list(F.col(text))})  # the cut minds quotes, so it is a function of its own
    hits = lambda s: F.when(F.exists("terms", lambda t: F.contains(s, t)), 1).otherwise(0)

    def judged(h: Column, cut: Column) -> Column:
        principle = X.let(first_sentence(h["text"], 220), lambda s: F.when(points(S.squeeze(s), PRINCIPLE) - F.when(is_scenario(s), 2).otherwise(0) + hits(s) >= 3, s))
        extra = lambda s: F.when(h["no"] > 1, 2).otherwise(0) + F.when(is_scenario(s), 2).otherwise(0) - F.when(S.any_of(s, ("보호법익", "의미")), 1).otherwise(0)
        decisive = lambda s: F.when(points(S.squeeze(s), HOLDING) + extra(s) + hits(s) >= 3, s)
        scenes = F.transform(F.filter(cut, is_scenario), lambda s: clamp(s, 180))
        told = lambda s: F.struct(principle.alias("principle"), decisive(s).alias("decisive"), scenes.alias("scenes"), s.alias("ending"), h["no"].alias("no"))
        return X.let(conclusion(h["text"], cut), told)

    rows = rows.withColumn("h", F.zip_with("held", "cuts", judged))
    none = F.array().cast("array<string>")
    of = lambda name: F.coalesce(F.transform("h", lambda x: x[name]), none)
    present = lambda a: F.array_distinct(F.filter(a, lambda s: s.isNotNull() & (s != "")))

    def issue_rows(pair: Column) -> Column:
        q = pair["q"]
        score = F.when(S.any_of(q, ("여부", "는지")), 6).otherwise(0) + F.when(F.size(quoted_terms(q)) > 0, 4).otherwise(0) + F.when(pair["p"] != "unknown", 2).otherwise(0)
        return F.struct((-(score + F.when(F.length(q) >= 18, 1).otherwise(0) - F.when(F.contains(q, F.lit("보호법익")), 2).otherwise(0))).alias("minus"), (-F.length(q)).alias("short"), q.alias("q"))

    asked = F.filter(F.zip_with("issues", "polarities", lambda i, p: F.struct(question_form(i).alias("q"), F.coalesce(p, F.lit("unknown")).alias("p"))), lambda x: x["q"] != "")
    told = F.filter("issues", lambda i: S.any_of(S.squeeze(i), ("사안에서", "사건에서", "기소된 사안", "한 사례")))
    fallback = F.transform(F.slice(F.filter("whole", is_scenario), 1, 1), lambda s: clamp(s, 170))
    scenes = present(F.concat(F.transform(told, lambda i: clamp(S.squeeze(i), 170)), F.flatten(F.coalesce(F.transform("h", lambda x: x["scenes"]), F.array().cast("array<array<string>>")))))
    holdings = present(F.concat(F.transform("issues", lambda i: X.let(case_conclusion(i), lambda c: F.when(c.isNotNull(), clamp(c, 220)))), of("decisive")))
    out = rows.withColumns({"asked": F.transform(F.array_sort(F.transform(asked, issue_rows)), lambda x: x["q"]), "decided": holdings, "scenes": scenes})
    out = out.withColumn("preferred", preferred_holding(F.coalesce(F.transform("h", lambda x: F.struct(x["no"].alias("no"), x["ending"].alias("text"))), F.array().cast("array<struct<no:int,text:string>>")), F.coalesce(F.get("asked", F.lit(0)), F.lit(""))))
    return out.select(
        doc,
        *keep,
        F.array_distinct("asked").alias("issues"),
        present(of("principle")).alias("principles"),
        F.when(F.size("decided") > 0, F.col("decided")).otherwise(present(F.array("preferred"))).alias("holdings"),
        F.when(F.size("scenes") > 0, F.col("scenes")).otherwise(fallback).alias("summaries"),
    )


def preferred_holding(endings: Column, issue: Column) -> Column:
    """Of the conclusions (no, text) the one that decides the case rather than repeating the
    issue; null without any."""
    plain = lambda t: F.regexp_replace(F.lower(t), "[^0-9a-zA-Z가-힣]", "")

    def score(h: Column) -> Column:
        t = h["text"]
        own, asked = plain(t), plain(issue)
        return (
            F.when(h["no"] > 1, 6).otherwise(0)
            + F.when(S.any_of(t, ("구성요건", "충족")), 4).otherwise(0)
            + F.when(S.any_of(t, ("법리오해", "잘못이 있다")), 4).otherwise(0)
            + F.when(S.any_of(t, ("사안에서", "사건에서")), 3).otherwise(0)
            + F.when(S.any_of(t, ("피고인", "원고", "갑", "을")), 2).otherwise(0)
            + F.when(F.length(t) >= 40, 2).otherwise(0)
            - F.when(own == asked, 10).otherwise(0)
            - F.when((asked != "") & (F.contains(own, asked) | F.contains(asked, own)), 7).otherwise(0)
        )

    return best_of(F.transform(F.filter(endings, lambda h: h["text"] != ""), lambda h: F.struct(score(h).alias("score"), h["text"].alias("value"))))


# ---- facts of a case ---------------------------------------------------------------------------------
def case_number(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, "(?U)" + S.CASE_NUMBER, 0), " ", "")


def court(text: Column) -> Column:
    return F.regexp_extract(text, COURTS, 0)


def decided_on(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"(?U)\d{4}\.\s*\d{1,2}\.\s*\d{1,2}", 0), " ", "")


def disposition(text: Column) -> Column:
    """The first two lines of the order; null where no order ends within 240 characters."""
    body = F.regexp_extract(text, r"(?U)주\s*문\s*\n+([\s\S]{0,240}?)(?:\n\s*이\s*유|\n\s*1\.)", 1)
    lines = F.filter(F.transform(F.split(body, "\n"), S.strip), lambda s: s != "")
    return F.nullif(F.array_join(F.slice(lines, 1, 2), " "), F.lit(""))


def _bare(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"(?U)^[\[\]〈〉<>\s]+|[\[\]〈〉<>\s]+$", ""), r"(?U)\s+", "")


def _no_party(value: Column) -> Column:
    return (value != "") & ~F.replace(value, F.lit("사건"), F.lit("")).isin(*LABELS)


def subject(text: Column) -> Column:
    """What a case is called: on the line of the case, in brackets, in a title; else empty."""
    t = F.coalesce(text, F.lit(""))
    line = _bare(F.regexp_extract(t, r"(?U)사\s*건\s*\n\s*\d{2,4}\s*[가-힣]{1,3}\s*\d+\s+([^\n]{2,60})", 1))
    found = F.regexp_extract_all(t, F.lit(r"\[[^\]]{2,30}\]|〈[^〉]{2,80}〉|<[^>]{2,80}>"), F.lit(0))
    fit = F.filter(F.transform(found, _bare), lambda c: F.length(c).between(2, 40) & ~c.isin(*LABELS) & ~c.rlike(r"^(공|미간행)|^\d{4}.*\d+$"))

    def of(c: Column) -> Column:
        asked = _bare(F.regexp_extract(c, r"([가-힣A-Za-z0-9·]+?)(?:가|이|은|는).{0,80}?문제된사[건안]", 1))
        case = F.regexp_extract(c, "([가-힣·]{2,20}사건)", 1)
        crime = F.when(c.endswith("죄") | S.any_of(c, ("위증", "사기", "강도", "절도")), c).otherwise(F.lit(""))
        return S.first_good([asked, case, crime], _no_party)

    bracket = F.get(F.filter(F.transform(fit, of), lambda s: s.isNotNull()), F.lit(0))
    title = F.regexp_replace(F.regexp_extract(t, r"(?U)([가-힣·]{2,20})\s*사건", 0), r"(?U)\s+", "")
    return F.coalesce(S.first_good([line, bracket, title], _no_party), F.lit(""))


def auto_name(keywords: Column, issue: Column) -> Column:
    """A name made of one or two keywords, legal ones first; of the last quoted noun of the
    issue; of its first noun."""
    hints = sorted({h for hs in vocab.DOMAIN_HINTS.values() for h in hs})
    good = F.filter(F.transform(keywords, S.strip), lambda k: F.length(k).between(2, 12) & ~k.rlike(r"^[\d\s\-_.]+$") & ~k.isin(*SOURCE_WORDS, *NO_NAMES))
    legal = F.filter(good, lambda k: F.exists(words_of(hints), lambda h: F.contains(h, k) | F.contains(k, h)))

    def named(pool: Column) -> Column:
        first = F.get(pool, F.lit(0))
        second = F.get(F.filter(pool, lambda k: ~F.contains(k, first) & ~F.contains(first, k)), F.lit(0))
        return F.when(first.isNotNull(), F.concat_ws(" ", first, second, F.lit("사건")))

    quoted = F.regexp_extract_all(issue, F.lit("['‘’\"]([가-힣A-Za-z0-9]{2,12})['‘’\"]"), F.lit(1))
    last = F.get(F.reverse(F.filter(quoted, lambda q: ~q.isin(*NO_NAMES))), F.lit(0))
    noun = F.get(F.filter(F.split(S.strip(issue), " "), lambda w: F.length(w).between(2, 10) & ~w.isin(*NO_NAMES)), F.lit(0))
    noun = F.nullif(F.regexp_replace(noun, r"[,.()\[\]]", ""), F.lit(""))
    from_words = X.let(F.when(F.size(legal) > 0, legal).otherwise(good), named)
    return F.coalesce(from_words, F.concat(last, F.lit(" 사건")), F.concat(noun, F.lit(" 관련 사건")), F.lit(""))


def section_flags(text: Column) -> Column:
    """Which parts of a judgment a text holds."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(
        F.contains(t, F.lit("판시사항")).alias("issues"),
        S.any_of(t, ("판결요지", "결정요지")).alias("holding"),
        F.contains(t, F.lit("참조조문")).alias("statutes"),
        F.contains(t, F.lit("참조판례")).alias("precedents"),
        t.rlike(r"(?U)(^|\n)\s*【?\s*이\s*유\s*】?\s*($|\n)").alias("reasoning"),
        S.any_of(t, ("다수의견", "반대의견", "보충의견", "별개의견")).alias("opinions"),
    )


def digest_domain(acts: Column, text: Column) -> Column:
    """The domain by acts, else by the laws in the text, where the code of criminal procedure
    counts before the criminal code; null if neither decides."""
    def of(bare: Column) -> Column:
        rest = F.replace(bare, F.lit("형사소송법"), F.lit(""))
        own = S.any_of(rest, SPECIAL_LAWS) | rest.rlike("형법(제|상|총칙|각칙)")
        return F.when(F.contains(bare, F.lit("형사소송법")), F.when(own, "criminal_law").otherwise("criminal_procedure_evidence")).otherwise(domain_of_laws(bare))

    found = F.coalesce(domain_of_acts(acts), X.let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""), of))
    return F.when(found == "civil_law", "civil_procedure").otherwise(found)


# ---- candidates of scanned text ---------------------------------------------------------------------------
def strip_sources(text: Column) -> Column:
    """Without brackets, citations and page marks."""
    # --- fixed values: what is cut out ---
    for pattern in (r"\[[^\]]+\]", r"\[\s*공\s*\d{2,4}.*$", r"\[공보[^\]]*$", r"\[[^\[\]]*$", "[〉〈]", r"\(\d{4}\.\s*\d{1,2}\.\s*\d{1,2}\.?\s*선고\s*\d{2,4}[가-힣]{1,3}\d+\s*판결\)", r"선고\s+\d{2,4}[가-힣]{1,3}\d+\s*판결", r"-\s*\d+\s*-"):
        text = F.regexp_replace(text, "(?U)" + pattern, " " if pattern == "[〉〈]" else "")
    return S.squeeze(text)


def display_sentence(text: Column, limit: int) -> Column:
    """A sentence to show: whole up to twice the limit, cut after an ending before that."""

    def of(t: Column) -> Column:
        dot = F.when(~S.ends_with(t, (".", "…")) & S.ends_with(t, ("다", "요")), F.concat(t, F.lit("."))).otherwise(t)
        end = X.last_end(F.left(t, F.lit(limit)), DISPLAY_ENDINGS)
        return F.when(F.length(t) <= limit, dot).when((end < max(20, limit // 3)) & (F.length(t) <= 2 * limit), t).otherwise(S.card_truncate(t, limit, DISPLAY_ENDINGS))

    return X.let(S.squeeze(text), of)


def is_fragment(text: Column) -> Column:
    """A raw piece of an issue list: what ``raw_fragment`` tells, or with a slash or ellipsis."""
    return X.let(S.strip(text), lambda t: S.raw_fragment(t) | F.contains(t, F.lit("/")) | t.startswith("여부") | S.ends_with(t, ("…", "...")))


def candidate_sentences(text: Column, key: Column) -> Column:
    """Sentences of 12 to 220 characters of the key sentences and the text, without headers,
    sources and torn beginnings, each once."""
    t = F.concat_ws("\n", F.nullif(key, F.lit("")), F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, "[<>〈〉《》「」『』】【]", "\n"), "(문제 ?된 사건)", "$1.\n")
    for torn, whole in (*S.SPACED_ENDINGS, *MORE_SPACED):
        t = F.replace(t, F.lit(torn), F.lit(whole))
    t = F.regexp_replace(t, r"(?U)\n\s*(는|은|이|가|을|를|의|에|에서|에게|도|와|과|로|으로|및|또는)\s", "$1 ")
    parts = F.transform(F.split(t, r"[\n。]|\. "), S.strip)
    # --- fixed values: lines that are no sentence ---
    bad = r"(?U)http|portal\.scourt|판례공보|미간행|^[\s\d\-:]+$|^\s*공\s*\d{4}|^[\s(]*\d{4}\.\s*\d{1,2}\.\s*\d{1,2}\.?\s*선고|^\s*선고\s+\d{2,4}[가-힣]{1,3}\d+\s*판결"
    return F.array_distinct(F.filter(parts, lambda s: F.length(s).between(12, 220) & ~s.rlike(bad) & ~F.left(s, F.lit(2)).isin(*SENTENCE_HEADS)))


def pick_issue(sentences: Column) -> Column:
    """The first sentence with a strong sign of an issue, with a weak one, or any; null if none."""
    tier = lambda marks: F.get(F.filter(sentences, lambda s: S.any_of(s, marks) & ~is_fragment(s)), F.lit(0))
    found = F.coalesce(tier(STRONG_ISSUE), tier(WEAK_ISSUE), F.get(F.filter(sentences, lambda s: ~is_fragment(s)), F.lit(0)))
    return X.let(found, lambda s: F.when(s.isNotNull(), display_sentence(S.drop_head(strip_sources(s), S.PARTICLES), 240)))


def pick_holding(sentences: Column, issue: Column) -> Column:
    """The first other sentence with a verdict, one that tells a case, or the issue if it has a
    verdict; null if none."""
    other = lambda s: (s != F.coalesce(issue, F.lit(""))) & ~is_fragment(s)
    verdict = F.get(F.filter(sentences, lambda s: S.any_of(s, VERDICT_WORDS) & other(s)), F.lit(0))
    told = F.get(F.filter(sentences, lambda s: (S.ends_with(s, ("사례", "사례.")) | S.any_of(s, ("법리오해의 잘못이 있다", "구성요건을 충족한다"))) & other(s)), F.lit(0))
    found = X.let(F.coalesce(verdict, told), lambda s: F.when(s.isNotNull(), strip_sources(s)))
    return X.let(F.coalesce(found, F.when(S.any_of(issue, VERDICT_WORDS), issue)), lambda s: F.when(s.isNotNull(), display_sentence(s, 130)))


def display_issue(issues: Column, polarities: Column) -> Column:
    """(issue, polarity): the issue to show, by polarity, topics and what makes it hard to read;
    null without issues."""

    def score(p: Column) -> Column:
        s = p["issue"]
        topics = sum((F.when(F.contains(s, F.lit(m)), n).otherwise(0) for m, n in TOPIC_POINTS), F.lit(0))
        return F.when(p["polarity"] != "unknown", 5).otherwise(0) + topics - F.when(s.startswith("여부"), 8).otherwise(0) - F.when(F.contains(s, F.lit("/")), 6).otherwise(0) - F.when(F.length(s) < 18, 3).otherwise(0)

    pairs = F.zip_with(issues, polarities, lambda i, p: F.struct(S.strip(S.issue_heads(S.strip(i))).alias("issue"), F.coalesce(p, F.lit("unknown")).alias("polarity")))
    return best_of(F.transform(pairs, lambda p: F.struct(score(p).alias("score"), p.alias("value"))))


def repaired_issue(issues: Column, polarities: Column, sentences: Column) -> Column:
    """The issue to show as a statement, else a sentence on witnesses or separated trials; null if
    neither can be read."""
    shown = X.let(display_issue(issues, polarities), lambda p: S.declarative(p["issue"], p["polarity"]))
    clean = F.filter(F.transform(sentences, lambda s: S.strip(S.issue_heads(strip_sources(s)))), lambda s: ~is_fragment(s) & S.any_of(s, ("증인이 될 수", "증인적격", "소송절차의 분리")))
    return S.first_good([shown, X.let(F.get(clean, F.lit(0)), lambda s: F.when(s.isNotNull(), display_sentence(s, 240)))], lambda s: ~is_fragment(s))


FIRST_PIECES = 32  # pieces of a text among which four sentences are looked for before all are cleaned


def refine_sentences(key: Column, text: Column) -> Column:
    """At most four sentences of ten characters or more, each once, cut at 140 characters."""
    raw = F.when(S.strip(key) == "", text).otherwise(key)

    def first_four(pieces: Column) -> Column:
        parts = F.filter(F.transform(pieces, S.strip), lambda s: (F.length(s) >= 12) & ~s.rlike(r"(?U)portal\.scourt|http|^[\d:\-]+$"))
        clean = F.transform(parts, lambda s: S.strip(F.regexp_replace(F.regexp_replace(S.squeeze(s), r"(?U)^[\s\-•·]+", ""), r"(?U)\s*[-–—]\s*\d+\s*[-–—]\s*$", "")))
        return F.slice(F.array_distinct(F.filter(clean, lambda s: F.length(s) >= 10)), 1, 4)

    def found(pieces: Column) -> Column:
        """Those of the first pieces, if they are four: the rest adds none."""
        return X.let(first_four(F.slice(pieces, 1, FIRST_PIECES)), lambda head: F.when(F.size(head) == 4, head).otherwise(first_four(pieces)))

    few = X.let(F.split(raw, "[\n。.!?]"), found)
    ended = F.transform(F.transform(few, lambda s: F.left(s, F.lit(140))), lambda s: F.when(s.endswith("."), s).when(S.ends_with(s, ("다", "요")), F.concat(s, F.lit("."))).otherwise(F.concat(s, F.lit("…"))))
    return F.array_join(ended, " ")


def is_time(word: Column) -> Column:
    """Rests of clock times and dates."""
    return word.rlike(r"^\d+경|^경부터|^경까지") | (word.rlike(r"^\d{1,3}[가-힣]{1,2}$") & ~word.rlike("[조항호]$"))


def scan_keywords(text: Column, k: int = 10) -> Column:
    """Formal signals, then words by score, until there are k; times and dates are no keywords."""
    t = F.coalesce(text, F.lit(""))
    formal = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit("(?U)" + p), F.lit(0)) for p in (vocab.LEGAL_PATTERNS[0], vocab.LEGAL_PATTERNS[1], f"(?:{COURTS})")]))
    formal = F.array_distinct(F.transform(formal, lambda m: F.regexp_replace(m, " ", "")))
    apart = r" \n\t.,()\[\]·:;〈-』"  # 〈〉《》「」『』
    found = F.regexp_extract_all(t, F.lit(f"([^가-힣{apart}]*+[가-힣][^{apart}]*+)|(?:[^가-힣{apart}]*+[{apart}]++){{1,100}}+"), F.lit(1))  # words with a syllable; up to a hundred others at a time are empty
    words = F.transform(F.filter(found, lambda w: w != ""), X.strip_ending)
    good = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.length(x["w"]).between(2, 14) & x["w"].rlike("[가-힣]") & ~x["w"].isin(*vocab.STOPWORDS) & ~is_time(x["w"]))

    def ranked(rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda x, j: F.struct(x.alias("x"), j.alias("j"))), lambda y: (y["j"] == 0) | (F.get(rows, y["j"] - 1)["w"] != y["x"]["w"]))

        def scores(s: Column) -> Column:
            n = lambda y, i: F.coalesce(F.get(s, i + 1)["j"], F.size(rows)) - y["j"]
            score = lambda y, i: n(y, i) + F.when(X.has_hint(y["x"]["w"], SCAN_HINTS), 1.8).otherwise(0.0) + F.when(S.ends_with(y["x"]["w"], SCAN_SUFFIXES), 1.0).otherwise(0.0) - F.when(S.ends_with(y["x"]["w"], ("하", "되")), 0.5).otherwise(0.0)
            return F.transform(F.array_sort(F.transform(s, lambda y, i: F.struct((-score(y, i)).alias("minus"), y["x"]["i"].alias("i"), y["x"]["w"].alias("w")))), lambda r: r["w"])

        return X.let(starts, scores)

    every = F.array_distinct(F.concat(formal, X.let(F.array_sort(good), ranked)))
    return F.slice(every, F.lit(1), F.greatest(F.lit(k), F.size(formal)))


# ---- the digest and rows -----------------------------------------------------------------------------------
def digest(parsed: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, case_number, subject, court, date, domain, issue, holding) of parsed judgments: by the
    roles of sentences, else what the parts give, else what sentences of the text look like;
    notices where nothing can be read. All marks of a part need Hangul, so they are looked for as far as there is any;
    only an issue may be a sentence after that, if there is none before."""
    parsed = parsed.withColumn("__reach", X.reach(F.coalesce(F.col(text), F.lit(""))))
    roles = sentence_roles(parsed.withColumn("__row", F.struct(*parsed.columns)), doc, text, ["__row"])
    rows = roles.select("__row.*", F.col("issues").alias("role_issues"), F.col("holdings").alias("role_holdings")).withColumn("said", candidate_sentences(F.col("__reach.lines"), F.lit("")))
    more = F.col("__reach.more")
    trimmed = lambda s: first_sentence(s, 160)
    shown = X.let(display_issue(F.col("issues"), F.col("polarities")), lambda p: S.declarative(p["issue"], p["polarity"]))
    asked = F.coalesce(X.let(F.get("role_issues", F.lit(0)), lambda s: F.when(s.isNotNull(), trimmed(s))), F.nullif(shown, F.lit("")), pick_issue(F.col("said")), pick_issue(candidate_sentences(F.col(text), F.lit(""))), F.lit(ISSUE_NOTICE))
    rows = rows.withColumn("asked", asked)
    last_issue = F.get("issues", F.size("issues") - 1)
    decided = F.coalesce(F.get("role_holdings", F.lit(0)), F.when(F.size("issues") > 1, case_conclusion(last_issue)), F.when(F.contains(more, F.lit("주")), disposition(F.col(text))), pick_holding(F.col("said"), F.col("asked")), F.lit(HOLDING_NOTICE))
    rows = rows.withColumn("decided", decided)
    issue = F.when(is_fragment(F.col("asked")), F.coalesce(repaired_issue(F.col("issues"), F.col("polarities"), F.col("said")), F.lit(ISSUE_NOTICE))).otherwise(F.col("asked"))
    holding = F.when(is_fragment(F.col("decided")) & (F.col("decided") != HOLDING_NOTICE), F.when(is_fragment(F.col("asked")), F.lit(HOLDING_NOTICE)).otherwise(F.col("asked"))).otherwise(F.col("decided"))
    body = F.array_join(F.concat("issues", F.transform("holdings", lambda h: h["text"])), "\n")
    hinted = X.let(classify.study_domain(F.when(F.size("issues") > 0, F.array_join("issues", " ")).otherwise(more)), lambda d: d)
    return rows.select(
        doc,
        case_number(more).alias("case_number"),
        subject(more).alias("subject"),
        court(more).alias("court"),
        decided_on(F.col(text)).alias("date"),
        F.coalesce(digest_domain(F.col("acts"), body), hinted).alias("domain"),
        issue.alias("issue"),
        holding.alias("holding"),
    )


def resolved_name(stored: Column, text: Column, number: Column) -> Column:
    """The stored name unless it is a party or a number; what the text says the case is about;
    the stored name after all, or the number."""
    t, own = F.coalesce(text, F.lit("")), S.strip(stored)
    good = lambda s: (s != "") & ~S.strip(F.replace(s, F.lit("사건"), F.lit(""))).isin(*PARTIES)
    line = S.strip(F.regexp_extract(t, r"(?U)사\s*건\s*\n\s*\d{2,4}\s*[가-힣]{1,3}\s*\d+\s+([^\n]{2,80})", 1))
    asked = S.strip(F.regexp_extract(t, r"(?U)([가-힣A-Za-z0-9·]+?)(?:가|이|은|는)[^\n]{0,80}?문제\s*된\s*사건", 1))
    kept = F.when(~own.rlike("(?U)^" + S.CASE_NUMBER + "$"), own)
    return F.coalesce(S.first_good([kept, line, asked], good), F.nullif(own, F.lit("")), number)


def case_rows(records: DataFrame) -> DataFrame:
    """Scanned records (id, case_number, case_name, raw_text, keywords, key_issue, key_sentences,
    ruling_point, exam_takeaway) as rows to show and, under search_*, rows to search: these
    also hold the beginning of the raw text and more keywords."""
    words = lambda n, sep: F.array_join(F.slice("keywords", 1, n), sep)
    number = F.coalesce(S.first_good([S.strip(F.col("case_number")), case_number(F.coalesce("raw_text", F.lit("")))], lambda s: s != ""), F.col("case_name"))
    issue = F.coalesce("key_issue", "key_sentences", F.lit(""))
    return records.select(
        "id",
        number.alias("case_number"),
        resolved_name(F.col("case_name"), F.col("raw_text"), number).alias("case_name"),
        F.lit("스캔 문서").alias("court_name"),
        words(3, " · ").alias("subject"),
        issue.alias("issue_summary"),
        F.col("ruling_point").alias("holding_summary"),
        F.coalesce("exam_takeaway", words(5, ", ")).alias("exam_points"),
        words(8, " · ").alias("search_subject"),
        F.concat_ws(" ", F.nullif(issue, F.lit("")), F.nullif(F.left(F.coalesce("raw_text", F.lit("")), F.lit(1500)), F.lit(""))).alias("search_summary"),
        F.coalesce("exam_takeaway", words(8, ", ")).alias("search_exam_points"),
    )

