"""Extraction as the reading device does it: normalised text, keyphrases with quotas, key
sentences by additive scores, domains by the names of laws, advice, and the path over a
parsed judgment. Everything is a column expression over one document at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statements as S
from ..functions import text as X
from ..functions import vocab
from ..functions.issues import ISSUES
from . import classify, clean, issues

# --- fixed values: what torn sentences begin with -----------------------------------------------
FRAGMENT_HEADS = (
    "는 ", "은 ", "이 ", "가 ", "을 ", "를 ", "에 ", "에서 ", "에게 ", "도 ", "와 ", "과 ", "로 ", "으로 ", "의 ", "및 ", "또는 ", "그리고 ", "하지만 ", "다만 ", "또한 ",
)
# --- fixed values: laws and their domains, in the order they are tried ------------------------------
LAW_DOMAINS = (
    ("criminal_law", ("형법",)),
    ("criminal_procedure_evidence", ("형사소송법",)),
    ("civil_law", ("민법", "민사소송법", "상법")),
    ("administrative_law", ("부가가치세법", "법인세법", "국세기본법", "행정소송법", "행정심판법", "행정절차법")),
    ("police_committees", ("경찰관 직무집행법", "경찰법")),
)
SPECIAL_CRIMINAL = (
    "성폭력", "특정범죄가중", "특정경제범죄", "정보통신망", "아동·청소년", "아동청소년", "청소년성보호", "마약류", "도로교통", "교통사고처리",
    "폭력행위 등 처벌", "스토킹", "공직선거법", "국가보안법",
)
SPECIAL_PUBLIC = ("국가공무원법", "지방공무원법", "개인정보 보호법", "부가가치세법", "법인세법", "국세기본법", "정보공개")
NAMED_IN_TEXT = (
    ("criminal_law", (
        "성폭력범죄의처벌등에관한특례법", "성폭력처벌법", "특정범죄가중처벌등에관한법률", "특정경제범죄가중처벌등에관한법률", "아동·청소년의성보호에관한법률",
        "아동청소년의성보호에관한법률", "청소년성보호법", "마약류관리에관한법률", "정보통신망이용촉진및정보보호등에관한법률", "스토킹범죄의처벌등에관한법률",
        "교통사고처리특례법", "폭력행위등처벌에관한법률", "도로교통법", "공직선거법", "국가보안법", "형법",
    )),
    ("criminal_procedure_evidence", ("형사소송법",)),
    ("administrative_law", ("부가가치세법", "법인세법", "국세기본법")),
    ("administrative_law", ("행정소송법", "행정심판법", "행정절차법", "국가공무원법", "지방공무원법", "개인정보보호법")),
    ("civil_law", ("민사소송법", "민법", "상법")),
    ("police_committees", ("경찰관직무집행법", "경찰법")),
)
TAX_HINTS = ("부가가치세", "법인세", "국세", "국세청장", "세무서장", "과세처분", "과세자료", "경정고지", "경정·고지", "면세", "과세대상", "취소소송")
DOMAIN_HINTS = {"administrative_law": TAX_HINTS, **vocab.DOMAIN_HINTS}
CLASS_DOMAINS = {
    "criminal_procedure": "criminal_procedure_evidence",
    "criminal_law": "criminal_law",
    "constitutional": "constitutional_law",
    "police_administrative": "police_committees",
}
CONSTITUTIONAL_ONLY = ("기본권", "과잉금지", "최소침해", "법익균형", "목적의 정당성", "수단적합성", "위헌", "합헌", "한정위헌", "헌법불합치")
# --- fixed values: advice by domain: lines, then what to say with and without words (w) or a sentence (s) ---
ADVICE = {
    "constitutional_law": (("10초 분기: 제한 기본권 특정 후 과잉금지/평등심사로 판단", "위헌/합헌 결론을 먼저 암기하고, 판례 번호와 연결해서 복습"), "s", "핵심 문장 체크: ", "위헌 사유를 목적·수단·최소침해·법익균형 순서로 분류"),
    "criminal_procedure_evidence": (("10초 분기: 임의수사/강제처분 구분 후 영장 원칙 확인", "증거 문제는 위법수집-전문법칙-자백법칙 순서로 OX 반복"), "w", "쟁점 키워드: ", "핵심 키워드 재확인"),
    "criminal_procedure_investigation": (("10초 분기: 체포유형(현행범/긴급/영장)부터 먼저 확정", "영장 예외는 긴급성·필요성·사후절차로 나눠 점검"), "s", "핵심 문장 체크: ", "핵심 문장 재확인"),
    "criminal_law": (("10초 분기: 구성요건-위법성-책임 순서로 쟁점 위치 확인", "정당방위/긴급피난, 미수/불능미수처럼 자주 섞이는 쌍을 분리 암기"), "w", "쟁점 키워드: ", "핵심 키워드 재확인"),
    "civil_law": (("10초 분기: 청구원인-항변-재항변 구조로 쟁점 위치 확인", "요건사실과 입증책임 분담을 먼저 정리하고 결론으로 연결"), "w", "쟁점 키워드: ", "핵심 키워드 재확인"),
    "administrative_law": (("10초 분기: 처분성-원고적격-협의의 소익 순서로 본안 전 점검", "재량/기속 구분 후 비례·신뢰보호 위반 여부 확인"), "w", "쟁점 키워드: ", "핵심 키워드 재확인"),
    "police_committees": (("10초 분기: 경찰조직/작용/징계 중 어디인지 먼저 분류", "위원회별 인원 범위·구성 요건·기한 숫자를 OX로 반복"), "w", "핵심 키워드 묶음: ", "한 글자/숫자 함정 지문을 중심으로 오답노트 축적"),
    "general_legal": (("10초 분기: 과목(형법/형소법/헌법/경찰학)을 먼저 확정", "핵심 쟁점-결론-시험포인트 3단 구조로 요약 후 복습", "헷갈리는 판례는 유사판례 2~3개와 비교하여 차이 암기"), "s", "핵심 문장 체크: ", "예외 요건 확인 후 결론 확정"),
}


def words_of(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


IMPORTANCE = {k: w for k, _, _, w in ISSUES}


def importance(term: Column) -> Column:
    table = F.create_map(*[x for k, w in IMPORTANCE.items() for x in (F.lit(k), F.lit(w))])
    return F.coalesce(F.try_element_at(table, term), F.lit(0))


# ---- text ---------------------------------------------------------------------------------------
def normalize(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text): noise lines and repeated lines dropped, web addresses dropped, torn words
    repaired, white space collapsed."""
    lines = clean.clean_lines(docs, doc, text)
    out = F.col(text)
    for pattern in (r"https?://\S+", r"www\.\S+", r"portal\.scourt\.go\.kr\S*"):
        out = F.regexp_replace(out, "(?U)" + pattern, " ")
    out = S.repair_spacing(F.regexp_replace(out, r"[\t\r\f\x0B]", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"\n{2,}", "\n"), r" {2,}", " ")
    return lines.select(doc, S.strip(out).alias(text))


def nouns(text: Column) -> Column:
    """Hangul words without their endings, in order; the tagger of nouns is not available."""
    return F.transform(F.regexp_extract_all(text, F.lit("[가-힣]{2,14}"), F.lit(0)), X.strip_ending)


def scored_nouns(text: Column, exclude: Column) -> Column:
    """Distinct nouns by score, of equals the first in the text: occurrences, hints, endings and
    the importance of issues. Words are sorted once, so a long text stays cheap."""
    at = F.transform(nouns(text), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    kept = F.filter(at, lambda x: (F.length(x["w"]) >= 2) & ~x["w"].isin(*vocab.STOPWORDS))

    def counted(rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda x, j: F.struct(x["w"].alias("w"), x["i"].alias("i"), j.alias("j"))), lambda x: (x["j"] == 0) | (F.get(rows, x["j"] - 1)["w"] != x["w"]))
        return X.let(starts, lambda s: F.transform(s, lambda x, k: F.struct(x["w"].alias("w"), x["i"].alias("i"), (F.coalesce(F.get(s, k + 1)["j"], F.size(rows)) - x["j"]).alias("n"))))

    def ranked(groups: Column) -> Column:
        score = lambda g: classify.term_score(g["w"], g["n"]) + importance(g["w"]) * 0.6
        order = F.array_sort(F.transform(groups, lambda g: F.struct((-score(g)).alias("minus"), g["i"].alias("i"), g["w"].alias("w"))))
        return F.filter(F.transform(order, lambda g: g["w"]), lambda w: ~F.array_contains(exclude, w))

    return X.let(X.let(F.array_sort(kept), counted), ranked)




def keyphrases(text: Column, k: int) -> Column:
    """At most k: a few formal signals, the issues named by importance, nouns by score, and the
    other formal signals; each once."""
    formal = F.filter(classify.legal_hits(text), lambda h: F.length(h) >= 2)
    quota, named = min(2, k // 4), min(4, k // 3)

    def pick(x: Column) -> Column:
        direct = F.array_sort(F.transform(x["direct"], lambda d, i: F.struct((-importance(d)).alias("minus"), i.alias("i"), d.alias("d"))))
        head = F.concat(F.slice(x["formal"], 1, quota), F.transform(F.slice(direct, 1, named), lambda d: d["d"]))
        rest = F.slice(x["formal"], F.lit(quota + 1), F.greatest(F.size(x["formal"]), F.lit(1)))
        return F.slice(F.array_distinct(F.concat(head, scored_nouns(x["text"], head), rest)), 1, k)

    return X.let(F.struct(F.coalesce(text, F.lit("")).alias("text"), formal.alias("formal"), issues.direct_issues(text).alias("direct")), pick)


def sentences(text: Column, least: int = 12) -> Column:
    """Sentences; a piece that begins with a particle belongs to the one before it."""
    split_at = r"(?U)(?<=[다요죠음임])[.。]\s+(?=[가-힣\[\d])|(?<=[다요죠음임])\s+(?=\[)|(?<=[.!?])\s+(?=[가-힣\[\d])|\n+"
    parts = F.filter(F.transform(F.split(text, split_at), S.strip), lambda s: s != "")
    heads = "^(?:" + "|".join(FRAGMENT_HEADS) + ")"
    joined = F.array_join(F.transform(parts, lambda s, i: F.concat(F.when((i > 0) & s.rlike(heads), " ").otherwise("\n"), s)), "")
    return F.filter(F.split(joined, "\n"), lambda s: F.length(s) >= least)


def key_sentences(text: Column, k: int) -> Column:
    """The k best sentences in the order of the text, one a line: a point for each keyphrase
    (more for issues), a little for hints and formal signals; ties go to the earlier one."""

    def best(x: Column) -> Column:
        def score(s: Column) -> Column:
            words = F.aggregate(x["words"], F.lit(0.0), lambda a, w: a + F.when(F.contains(s, w), F.lit(1.0) + importance(w) * 0.3).otherwise(0.0))
            full = words + X.count_hints(s, vocab.TERM_HINTS) * 0.2 + F.when(F.size(classify.legal_hits(s)) > 0, 0.3).otherwise(0.0)
            return F.when(s.rlike(r"(?U)[가-힣\d]"), full).otherwise(0.0)  # every keyphrase, hint and signal has a syllable or digit

        order = F.array_sort(F.transform(x["sentences"], lambda s, i: F.struct((-F.round(score(s), 9)).alias("minus"), i.alias("i"))))
        top = F.array_sort(F.transform(F.slice(order, 1, k), lambda o: o["i"]))
        return F.array_join(F.transform(top, lambda i: F.get(x["sentences"], i)), "\n")

    def made(found: Column) -> Column:
        return F.when(F.size(found) <= k, F.array_join(found, "\n")).otherwise(X.let(F.struct(found.alias("sentences"), keyphrases(text, 20).alias("words")), best))

    return X.let(sentences(text), made)


# ---- domains -------------------------------------------------------------------------------------
def domain_of_acts(acts: Column) -> Column:
    """The domain of the first act that decides one; null if none does."""

    def of(act: Column) -> Column:
        out = F
        for name, laws in LAW_DOMAINS:
            out = out.when(act.isin(*laws), name)
        return out.when(S.any_of(act, SPECIAL_CRIMINAL), "criminal_law").when(S.any_of(act, SPECIAL_PUBLIC), "administrative_law")

    found = F.get(F.filter(F.transform(acts, of), lambda d: d.isNotNull()), F.lit(0))
    return F.coalesce(found, F.when((F.size(acts) == 1) & (F.get(acts, F.lit(0)) == "헌법"), "constitutional_law"))


def domain_of_laws(text: Column) -> Column:
    """The domain of the laws that a text names, white space aside; null if it names none."""

    def of(bare: Column) -> Column:
        out = F
        for name, laws in NAMED_IN_TEXT:
            out = out.when(S.any_of(bare, laws), name)
        return out.otherwise(F.lit(None).cast("string"))

    return X.let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""), of)


def domain_of_hints(text: Column, keywords: Column) -> Column:
    """The domain with the most hints, two at least; of equals the first. Forms like "in the
    constitution's sense" don't count, and where the code of criminal procedure is named, the
    criminal code needs an article or part after it. Else the weighted class, if sure enough."""
    corpus = F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.array_join(keywords, " ")))
    corpus = F.replace(F.regexp_replace(F.replace(corpus, F.lit("헌법재판소"), F.lit("\u0001")), "헌법상|헌법적", " "), F.lit("\u0001"), F.lit("헌법재판소"))

    def scores(c: Column) -> Column:
        own = c.rlike("형법(제|상|총칙|각칙)") | ~F.contains(c, F.lit("형사소송법"))
        count = lambda hints: X.count_hints(c, [h for h in hints if h != "형법"]) + (F.when(F.contains(c, F.lit("형법")) & own, 1).otherwise(0) if "형법" in hints else F.lit(0))
        return F.array(*[count(h) for h in DOMAIN_HINTS.values()])

    def pick(s: Column) -> Column:
        return F.when(F.array_max(s) >= 2, F.get(words_of(DOMAIN_HINTS), F.array_position(s, F.array_max(s)) - 1))

    weighted = X.let(classify.study_class(text, keywords), lambda c: F.when(c["confidence"] >= 0.5, F.try_element_at(F.create_map(*[F.lit(x) for p in CLASS_DOMAINS.items() for x in p]), c["name"])))
    return F.coalesce(X.let(X.let(corpus, scores), pick), weighted, F.lit(vocab.GENERAL_DOMAIN))


def domain(acts: Column, text: Column, keywords: Column) -> Column:
    """By the acts of the statutes, by the laws that the text names, by hints."""
    return F.coalesce(domain_of_acts(acts), domain_of_laws(text), domain_of_hints(text, keywords))


def study_focus(name: Column, keywords: Column, key: Column) -> Column:
    """Lines of advice for a domain."""
    named = F.array_join(F.slice(keywords, 1, 4), ", ")
    first = F.left(F.coalesce(F.get(F.filter(F.split(key, "\n"), lambda s: s != ""), F.lit(0)), F.lit("")), F.lit(90))

    def lines(domain_name: str) -> Column:
        fixed, what, label, without = ADVICE[domain_name]
        value = named if what == "w" else first
        return F.array(*map(F.lit, fixed), F.when(value == "", F.lit(without)).otherwise(F.concat(F.lit(label), value)))

    out = F
    for d in ADVICE:
        if d != vocab.GENERAL_DOMAIN:
            out = out.when(name == d, lines(d))
    return out.otherwise(lines(vocab.GENERAL_DOMAIN))


# ---- the path over a parsed judgment -----------------------------------------------------------------
def majority(holdings: Column) -> Column:
    return F.filter(holdings, lambda h: h["opinion"].isin("majority", "unspecified"))


def first_sentence(text: Column, limit: int = 200) -> Column:
    """A text within the limit as it is, else its first sentence of 40 characters or more, else
    its beginning with an ellipsis."""

    def cut(t: Column) -> Column:
        head = F.regexp_extract(t, r"(?Us)^(.*?[.])(?:\s|$)", 1)
        return F.when(F.length(t) <= limit, S.resolve_pronouns(t)).when((head != "") & (F.length(head) > 40), S.resolve_pronouns(head)).otherwise(F.concat(S.resolve_pronouns(F.left(t, F.lit(limit))), F.lit("…")))

    return X.let(S.strip(text), cut)


def extract_parsed(parsed: DataFrame, doc: str, text: str, words: int = 10, lines: int = 4) -> DataFrame:
    """(doc, keywords, key_sentences, domain, focus) of parsed judgments: from the issues and the
    majority's holdings; acts lead the keywords; constitutional terms go from other domains."""
    rows = parsed.withColumn("__held", F.transform(majority(F.col("holdings")), lambda h: h["text"]))
    rows = rows.withColumn("__corpus", F.array_join(F.concat("issues", "__held"), "\n"))
    rows = rows.withColumn("__words", keyphrases(F.when(F.col("__corpus") == "", F.col(text)).otherwise(F.col("__corpus")), words))
    rows = rows.withColumn("domain", domain(F.col("acts"), F.col("__corpus"), F.col("__words")))
    every = F.array_distinct(F.concat("acts", "__words"))
    kept = F.when(F.col("domain") == "constitutional_law", every).otherwise(F.filter(every, lambda w: ~w.isin(*CONSTITUTIONAL_ONLY)))
    said = F.zip_with("issues", "polarities", lambda i, p: S.declarative(i, F.coalesce(p, F.lit("unknown"))))
    told = F.concat(F.filter(said, lambda s: s != ""), F.transform("__held", lambda h: first_sentence(h)))
    rows = rows.withColumns({"keywords": F.slice(kept, 1, words), "key_sentences": F.array_join(F.slice(told, 1, max(lines, 4)), "\n")})
    return rows.select(doc, "keywords", "key_sentences", "domain", study_focus(F.col("domain"), F.col("keywords"), F.col("key_sentences")).alias("focus"))
