"""Statements of judgments as column functions: repair, display form, verdicts, truth statements."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import last_end, let, trimmed

# --- fixed values: compounds that line breaks tear apart ------------------------------------
COMPOUNDS = (
    "송금메모", "통신매체", "통신매체이용음란", "전자금융거래", "성폭력처벌법", "성폭력범죄", "성적자기결정권", "성적수치심",
    "정보통신망", "도로교통법", "교통사고처리", "스토킹범죄", "청소년성보호", "마약류관리", "보호법익", "구성요건",
    "법리오해", "원심판결", "공소사실", "유죄판결", "무죄판결", "헌법재판소", "대법원판결", "위법수집증거", "전문법칙",
    "임의제출", "강제수사", "임의수사", "수색영장", "체포영장", "공무집행방해", "주거침입", "음주운전", "특정범죄가중처벌",
    "정당방위", "긴급피난", "과잉방위", "공동정범", "간접정범",
)
TORN_VERB = r"([하되있없이리기쓰오가받두주]|[하되있없]였|[하되있없]었)\s+(는|던|면|어|아|니|고|자|지|며|여|였|었)"
TORN_PAIRS = (
    ("문제 된", "문제된"), ("관 한", "관한"), ("관 하여", "관하여"), ("관 해", "관해"), ("대 한", "대한"), ("대 하여", "대하여"),
    ("대 해", "대해"), ("의 한", "의한"), ("의 하여", "의하여"), ("의 해", "의해"), ("따 라", "따라"), ("따 른", "따른"),
    ("따 라서", "따라서"), ("위 한", "위한"), ("위 하여", "위하여"), ("포함 되", "포함되"), ("배제 되", "배제되"),
    ("인정 되", "인정되"), ("부정 되", "부정되"),
)
# --- fixed values: question endings, with what affirms and what denies them ---------------------
QUESTIONS = (
    ("할 수 있는지", "할 수 있다.", "할 수 없다."),
    ("할 수 없는지", "할 수 없다.", "할 수 있다."),
    ("수 있는지", "수 있다.", "수 없다."),
    ("해당하는지", "해당한다.", "해당하지 않는다."),
    ("성립하는지", "성립한다.", "성립하지 않는다."),
    ("인정되는지", "인정된다.", "인정되지 않는다."),
    ("적용되는지", "적용된다.", "적용되지 않는다."),
    ("허용되는지", "허용된다.", "허용되지 않는다."),
    ("위반되는지", "위반된다.", "위반되지 않는다."),
    ("필요한지", "필요하다.", "필요하지 않다."),
    ("가능한지", "가능하다.", "가능하지 않다."),
    ("타당한지", "타당하다.", "타당하지 않다."),
    ("정당한지", "정당하다.", "정당하지 않다."),
    ("위법한지", "위법하다.", "위법하지 않다."),
    ("적법한지", "적법하다.", "적법하지 않다."),
    ("되는지", "된다.", "되지 않는다."),
    ("하는지", "한다.", "하지 않는다."),
    ("있는지", "있다.", "없다."),
    ("없는지", "없다.", "있다."),
)
IN_SOME_CASES = "일정한 경우 "
QUOTES = "'‘’\"“”"
PRONOUNS = ("에", "를", "가", "는", "도", "와")  # particles after the pronoun 이
POINTERS = ("이에 ", "이를 ", "이가 ", "이는 ", "이도 ", "이와 ", "이러한 경우", "이러한 행위", "이러한 사정")
# --- fixed values: signs of a verdict and how it is told, in the order they are tried -------------
VERDICTS = (
    ("(적극)", "적극적으로"), ("(소극)", "소극적으로"), ("충족한다", "구성요건을 충족한다고"), ("충족하지 않는다", "구성요건을 충족하지 않는다고"),
    ("포함되지 않는다", "포함되지 않는다고"), ("포함된다", "포함된다고"), ("해당하지 않는다", "해당하지 않는다고"), ("해당한다", "해당한다고"),
    ("위법하다", "위법하다고"), ("적법하다", "적법하다고"), ("유죄", "유죄로"), ("무죄", "무죄로"), ("기각", "기각"), ("인용한다", "인용"),
    ("위반된다", "위반된다고"), ("허용되지 않는다", "허용되지 않는다고"), ("허용된다", "허용된다고"), ("한정위헌", "한정위헌으로"),
    ("헌법불합치", "헌법불합치로"), ("위헌", "위헌으로"), ("합헌", "합헌으로"), ("파기환송", "파기환송"), ("파기한다", "파기"), ("환송한다", "환송"),
    ("성립하지 않는다", "성립하지 않는다고"), ("성립한다", "성립한다고"), ("인정되지 않는다", "인정되지 않는다고"), ("인정된다", "인정된다고"),
)
# --- fixed values: residual spaces, marks of raw fragments, of guidance and of topics ---------------
SPACED_ENDINGS = (("하 는", "하는"), ("되 는", "되는"), ("이 다", "이다"), ("한 다", "한다"), ("된 다", "된다"), ("하 다", "하다"), ("있 다", "있다"), ("없 다", "없다"))
POLARITY_MARKS = ("(적극)", "(소극)", "(한정 적극)", "(한정적극)", "(한정 소극)", "(한정소극)")
TORN_QUOTE = r"^[가-힣]{1,2}['‘’\"][가-힣]?\s*(가|이|을|를|은|는|의|에|로|와|과)\s"
GUIDANCE_MARKS = (
    "10초 분기", "본문 키워드", "쟁점 키워드", "분리 암기", "암기 포인트", "암기 팁", "암기하라", "학습 가이드", "구성요건-위법성-책임",
    "구성요건·위법성·책임", "정당방위/긴급피난", "미수/불능미수",
)
PREDICATES = ("이다", "한다", "된다", "해당")
TOPIC_ENDINGS = (
    "문제된 사건", "문제 된 사건", "문제된 사안", "문제 된 사안", "된 사건", "된 사안", "된 경우", "관한 사건", "관련된 사건", "대한 사건", "문제된 판례", "된 판례",
)
NOTICE_MARKS = (
    "자동 추출하지 못했습니다", "본문이 입력에 포함되지 않아", "단락을 함께 붙여넣으면", "카드가 채워집니다", "다시 촬영하거나 붙여넣으면",
    "OCR에서 추출하지 못했다", "원문을 확인하라", "원문을 확인하세요", "복원하지 못했습니다", "정보가 부족", "정보 부족",
)
# --- fixed values: particles that a torn line begins with --------------------------------------------
PARTICLES = ("는 ", "은 ", "이 ", "가 ", "을 ", "를 ", "의 ", "에 ", "도 ", "와 ", "과 ", "로 ", "으로 ")
# --- fixed values: limits and texts of cards ------------------------------------------------------------
ISSUE_LIMIT, RULING_LIMIT, EXAM_LIMIT = 360, 420, 260
NO_ISSUE, BROKEN_ISSUE = "핵심 쟁점 정보가 부족합니다.", "핵심 쟁점 문장을 완전하게 복원하지 못했습니다."
NO_RULING, BROKEN_RULING = "판결 결론 정보가 부족합니다.", "판결 결론 문장을 완전하게 복원하지 못했습니다."
NO_EXAM, BROKEN_EXAM = "시험 포인트 정보가 부족합니다.", "시험 포인트 문장을 완전하게 복원하지 못했습니다."
CUT_MARK = " (이하 생략)"
CARD_ENDINGS = ("다.", "요.", "음.", "임.", "였다.", "한다.", "된다.", "이다.", "?", "!", ".", "…")
CORE_MARKERS = ("문제 된 사건", "문제된 사건", "여부", "되는지", "할 수 있는지", "해당하는지", "허용되는지")
ANSWER_ENDINGS = ("다.", "다 ", "요.", "임.", "다고 한다.", "였다.", "이다.", "한다.", "된다.")
# --- fixed values: topic labels that become assertions, where a merged statement stops, safe negations ----
TOPIC_ASSERTIONS = (
    (r"되는지가?\s*문제\s*된\s*사건$", "된다"),
    (r"되는지가?\s*문제\s*된\s*사안$", "된다"),
    (r"할\s*수\s*있는지가?\s*문제\s*된\s*사건$", "할 수 있다"),
    (r"해당하는지가?\s*문제\s*된\s*사건$", "해당한다"),
    (r"인정되는지가?\s*문제\s*된\s*사건$", "인정된다"),
    (r"여부가?\s*문제\s*된\s*사건$", "문제가 된다"),
)
STATEMENT_ENDS = (
    "한다.", "된다.", "있다.", "없다.", "해당한다.", "성립한다.", "충족한다.", "위법하다.", "정당하다.", "인정된다.", "허용된다.", "적법하다.", "위반된다.",
    "적용된다.", "한 사례.", "사례.",
)
SAFE_FLIPS = (
    ("해당한다", "해당하지 않는다"), ("인정된다", "인정되지 않는다"), ("적용된다", "적용되지 않는다"), ("성립한다", "성립하지 않는다"),
    ("포함된다", "포함되지 않는다"), ("허용된다", "허용되지 않는다"), ("위법하다", "적법하다"), ("적법하다", "위법하다"),
)
STATEMENT_LIMIT = 88
CASE_NUMBER = r"\d{2,4}\s*[가-힣]{1,3}\s*\d+"


# ---- small things -----------------------------------------------------------------------------
def strip(text: Column) -> Column:
    return trimmed(F.coalesce(text, F.lit("")))


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def any_of(text: Column, marks) -> Column:
    return text.rlike("|".join(map(re.escape, marks)))


def ends_with(text: Column, endings) -> Column:
    return text.rlike("(?:" + "|".join(map(re.escape, endings)) + r")\z")


def drop_head(text: Column, heads) -> Column:
    return F.regexp_replace(text, "^(?:" + "|".join(map(re.escape, heads)) + ")", "")


def first_case(cases, otherwise: Column) -> Column:
    """The value of the first test that holds."""
    out = F
    for test, value in cases:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def first_good(values: list[Column], good) -> Column:
    """The first value for which ``good`` holds; null if none."""
    return F.get(F.filter(F.array(*values), lambda v: v.isNotNull() & good(v)), F.lit(0))


# ---- repair of scanned text ----------------------------------------------------------------------
def repair_spacing(text: Column) -> Column:
    """Puts torn compounds, verb endings and listed pairs together again."""
    for word in COMPOUNDS:
        text = F.regexp_replace(text, "[ \\t\\n]{0,2}".join(word), word)
    text = F.regexp_replace(text, "(?U)" + TORN_VERB, "$1$2")
    for torn, whole in TORN_PAIRS:
        text = F.replace(text, F.lit(torn), F.lit(whole))
    return text


def scrub(text: Column) -> Column:
    """Without bracketed sources, stray angle quotes and spaces before endings."""
    for pattern, by in ((r"\[[^\]]{1,80}\]", ""), (r"(?U)\[\s*공\s*\d{2,4}.*$", ""), (r"\[공보[^\]]*$", ""), ("[〉〈]", " ")):
        text = F.regexp_replace(text, pattern, by)
    for torn, whole in SPACED_ENDINGS:
        text = F.replace(text, F.lit(torn), F.lit(whole))
    return squeeze(text)


# ---- Hangul syllables ---------------------------------------------------------------------------------
def has_final(text: Column) -> Column:
    """Whether the last syllable ends in a consonant; null if the text doesn't end in one."""
    code = F.ascii(F.right(text, F.lit(1)))  # the code point
    return F.when(code.between(0xAC00, 0xD7A3), (code - 0xAC00) % 28 != 0)


def object_particle(text: Column) -> Column:
    return F.when(has_final(text) == F.lit(False), "를").otherwise("을")


def particle(text: Column, after_consonant: str, after_vowel: str) -> Column:
    return F.when(has_final(text), after_consonant).otherwise(after_vowel)


# ---- questions and pronouns ---------------------------------------------------------------------------
def quoted_noun(text: Column) -> Column:
    return strip(F.regexp_extract(text, f"(?U)[{QUOTES}]([가-힣A-Za-z0-9·\\s]{{2,18}})[{QUOTES}]", 1))


def resolve_pronouns(text: Column) -> Column:
    """이 with a particle becomes the first quoted noun, if that stands before it."""

    def replaced(x: Column) -> Column:
        t, noun = x["t"], x["noun"]
        out, at = t, F.regexp_instr(t, F.lit(r"(?U)이[에를가는도와]\s"))
        for p in PRONOUNS:
            out = F.replace(out, F.lit(f"이{p} "), F.concat(F.lit("'"), noun, F.lit(f"'{p} ")))
        for q in "'‘’":
            out = F.replace(out, F.lit(q * 2), F.lit(q))
        return F.when((noun != "") & (at > 0) & (F.instr(t, noun) < at), out).otherwise(t)

    return let(strip(text), lambda t: F.when(any_of(t, POINTERS), let(F.struct(t.alias("t"), quoted_noun(t).alias("noun")), replaced)).otherwise(t))


def declarative(issue: Column, polarity: Column) -> Column:
    """An issue in question form as a statement, affirmed or denied by its polarity."""
    for mark in (r"한정\s*적극", r"한정\s*소극", "적극", "소극"):
        issue = F.regexp_replace(issue, rf"(?U)\s*\(\s*{mark}\s*\)\s*\.?\s*$", "")
    bare = strip(F.regexp_replace(issue, r"(?U)\s*여\s*부\s*\.?\s*$", ""))
    limited, denied = polarity.startswith("limited"), polarity.isin("negative", "limited_negative")

    def said(s: Column) -> Column:
        cases = [(s.endswith(q), F.concat(F.left(s, F.length(s) - len(q)), F.when(denied, no).otherwise(yes))) for q, yes, no in QUESTIONS]
        cases.append((s.endswith("는지"), F.concat(F.left(s, F.length(s) - 2), F.when(denied, "지 않는다.").otherwise("다."))))
        full = first_case(cases, F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit("."))))
        return F.when(s == "", s).otherwise(resolve_pronouns(F.concat(F.when(limited, IN_SOME_CASES).otherwise(""), full)))

    return let(F.regexp_replace(F.regexp_replace(bare, "^위 ", ""), "^및 ", ""), said)


def verdict(holding: Column) -> Column:
    """How a holding decides; empty if no sign is in it."""
    return first_case([(F.contains(holding, F.lit(sign)), F.lit(told)) for sign, told in VERDICTS], F.lit(""))


def near_equal(a: Column, b: Column) -> Column:
    """Equal, one within the other, or 0.7 of the words of the longer one in common."""
    plain = lambda x: squeeze(F.regexp_replace(F.lower(x), r"(?U)[^0-9a-zA-Z가-힣\s]", " "))

    def test(x: Column) -> Column:
        wa, wb = F.array_distinct(F.split(x["a"], " ")), F.array_distinct(F.split(x["b"], " "))
        share = F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.size(wb))
        return (x["a"] != "") & (x["b"] != "") & (F.contains(x["a"], x["b"]) | F.contains(x["b"], x["a"]) | (share >= 0.7))

    return let(F.struct(plain(a).alias("a"), plain(b).alias("b")), test)


# ---- predicates ------------------------------------------------------------------------------------------
def is_question(t: Column) -> Column:
    return ends_with(t, ("여부", "여부.", "는지", "는지."))


def raw_fragment(text: Column) -> Column:
    """A piece of an issue list rather than a statement."""
    return let(strip(text), lambda t: (t == "") | any_of(t, POLARITY_MARKS) | is_question(t) | t.rlike("(?U)" + TORN_QUOTE))


def broken_text(text: Column) -> Column:
    return let(strip(text), lambda t: t.startswith("여부") | F.contains(t, F.lit("/")) | ends_with(t, ("…", "...", "(이하 생략)")) | (F.length(t) < 12))


def guidance_line(text: Column) -> Column:
    """Advice for learners or a list of words, not a statement."""
    many = lambda t: (F.regexp_count(t, F.lit(",")) >= 4) & ~any_of(t, PREDICATES)
    return let(strip(text), lambda t: (t == "") | any_of(t, GUIDANCE_MARKS) | many(t))


def topic_line(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip(text), r"(?U)\s*\[[^\]]*\]?\s*$", ""), r"(?U)\s*\([^)]*\)?\s*$", "")
    return ends_with(strip(bare), TOPIC_ENDINGS)


def weak_evidence(text: Column) -> Column:
    """Nothing that a card or a statement may be built on."""
    return let(strip(text), lambda t: (t == "") | any_of(t, NOTICE_MARKS) | guidance_line(t) | broken_text(t))


def declares(text: Column) -> Column:
    return let(strip(text), lambda t: (F.length(t) >= 10) & t.endswith("다.") & ~ends_with(t, ("문제 된 사건", "문제된 사건")) & ~is_question(t))


# ---- shortening --------------------------------------------------------------------------------------------
def shrink(text: Column, limit: int) -> Column:
    """Lines joined; beyond the limit cut after its last full stop, question or exclamation mark."""
    joined = F.array_join(F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x85  ]"), strip), lambda x: x != ""), " ")

    def cut(t: Column) -> Column:
        head = F.left(t, F.lit(limit))
        return F.when(F.length(t) <= limit, t).otherwise(strip(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*[.!?])", 1), F.lit("")), head)))

    return let(joined, cut)


def card_terminal(text: Column) -> Column:
    """A full stop where a text doesn't end as a sentence does."""
    return let(strip(text), lambda t: F.when((t == "") | ends_with(t, CARD_ENDINGS), t).otherwise(F.concat(t, F.lit("."))))


def card_truncate(text: Column, limit: int, endings: tuple[str, ...]) -> Column:
    """Shortened after the last sentence ending or else at the last space, not in the first
    third, with a mark that something is left out."""
    least = max(20, limit // 3)

    def cut(x: Column) -> Column:
        short = F.when((x["space"] >= least) & (x["space"] < F.length(x["head"])), F.left(x["head"], x["space"])).otherwise(x["head"])
        return F.when(x["end"] >= least, strip(F.left(x["head"], x["end"]))).otherwise(F.concat(strip(short), F.lit(CUT_MARK)))

    def measured(head: Column) -> Column:
        return F.struct(head.alias("head"), last_end(head, endings).alias("end"), (F.length(head) - F.locate(" ", F.reverse(head))).alias("space"))

    return let(squeeze(text), lambda t: F.when(F.length(t) <= limit, t).otherwise(let(let(F.left(t, F.lit(limit)), measured), cut)))


# ---- card texts -----------------------------------------------------------------------------------------------
def slash_side(text: Column) -> Column:
    """Of two clauses around the first slash the left one, unless it is a torn rest."""
    left, right = strip(F.regexp_extract(text, r"(?s)^(.*?)/", 1)), strip(F.regexp_extract(text, r"(?s)^.*?/(.*)$", 1))
    return F.when(F.contains(text, F.lit("/")), F.when((left == "") | left.startswith("여부"), right).otherwise(left)).otherwise(text)


def asserted(text: Column) -> Column:
    """A statement of what carries a polarity mark or is a question."""
    yes, no = any_of(text, ("(적극)", "(한정 적극)", "(한정적극)")), any_of(text, ("(소극)", "(한정 소극)", "(한정소극)"))
    polarity = F.when(yes, "positive").when(no, "negative").otherwise("positive")
    return F.when(yes | no | is_question(text), F.coalesce(F.nullif(declarative(text, polarity), F.lit("")), text)).otherwise(text)


def issue_heads(text: Column) -> Column:
    out = F.regexp_replace(slash_side(text), r"(?U)^여부\s*(\((적극|소극|한정 적극|한정 소극|한정적극|한정소극)\))?\s*", "")
    return F.regexp_replace(out, r"(?U)^위증죄의 주체와 관련하여,\s*", "")


def canonical_issue(raw: Column) -> Column:
    def finish(s: Column) -> Column:
        return F.when(broken_text(s) | raw_fragment(s), F.lit(BROKEN_ISSUE)).otherwise(card_terminal(shrink(s, ISSUE_LIMIT)))

    return let(scrub(raw), lambda s: F.when(s == "", F.lit(NO_ISSUE)).otherwise(let(squeeze(let(issue_heads(s), asserted)), finish)))


def canonical_ruling(raw: Column) -> Column:
    def finish(s: Column) -> Column:
        middle = (s.startswith("위의 진술") | s.startswith("이와 같은 진술")) & ~any_of(s, ("한 사례", "정당하다", "잘못이 있다"))
        return F.when(s == "", F.lit(NO_RULING)).when(middle | broken_text(s), F.lit(BROKEN_RULING)).otherwise(card_terminal(shrink(s, RULING_LIMIT)))

    return let(scrub(raw), finish)


def canonical_exam(raw: Column) -> Column:
    return let(scrub(raw), lambda s: F.when(s == "", F.lit(NO_EXAM)).when(broken_text(s), F.lit(BROKEN_EXAM)).otherwise(card_terminal(shrink(s, EXAM_LIMIT))))


def card_text(raw: Column, role: str) -> Column:
    """The looser form of a card's text; empty where nothing can be shown."""
    text = squeeze(raw)
    if role == "issue":
        marked = let(text, issue_heads)
        text = let(marked, lambda t: F.when(is_question(t), t).otherwise(asserted(t)))

    def finish(t: Column) -> Column:
        bad = broken_text(t) | (t.startswith("위의 진술") if role == "ruling" else F.lit(False))
        dot = ~ends_with(t, (".", "?", "!")) & (F.lit(True) if role == "exam" else ends_with(t, ("다", "요")))
        return F.when(bad, F.lit("")).when(dot, F.concat(t, F.lit("."))).otherwise(t)

    return let(text, finish)


# ---- topics -----------------------------------------------------------------------------------------------------
def issue_core(issue: Column) -> Column:
    """The noun phrase of an issue: up to the first marker, if that leaves 8 to 90 characters."""
    clean = squeeze(F.regexp_replace(F.regexp_replace(strip(issue), r"(?U)^\[[^\]]*\]\s*", ""), "[〉〈]", " "))

    def core(s: Column) -> Column:
        heads = [strip(F.regexp_extract(s, rf"^(.*?{re.escape(m)})", 1)) for m in CORE_MARKERS]
        head = first_good(heads, lambda h: F.length(h).between(8, 90))
        clean_head = F.regexp_replace(F.regexp_replace(head, r"(?U)^[\s,.;:\-]+", ""), r"(?U)\s*사건$", "")
        cut = F.left(s, F.lit(70))
        at_space = F.regexp_extract(cut, r"^(.*) ", 1)
        return F.coalesce(clean_head, F.when(F.length(s) <= 70, s).when(at_space != "", at_space).otherwise(cut))

    return let(drop_head(clean, PARTICLES), core)


def compact_topic(statement: Column) -> Column:
    """The crime and at most two quoted nouns; else the first two words."""

    def pick(t: Column) -> Column:
        crime = F.regexp_extract(t, "([가-힣]{2,15}죄)", 1)
        quoted = F.array_distinct(F.regexp_extract_all(t, F.lit("['‘’\"]([가-힣A-Za-z0-9]{2,12})['‘’\"]"), F.lit(1)))
        parts = F.concat(F.filter(F.array(crime), lambda c: c != ""), F.slice(quoted, 1, 2))
        return F.when(F.size(parts) > 0, F.array_join(parts, " / ")).otherwise(F.array_join(F.slice(F.split(t, r"(?U)\s+"), 1, 2), " "))

    return let(strip(statement), pick)


def one_line(label: Column, name: Column, issue: Column, holding: Column, limit: int = 120) -> Column:
    """[label] name 사건. what was asked and how it was decided."""

    def line(x: Column) -> Column:
        core, told = x["core"], x["verdict"]
        tail = first_case(
            [
                ((told != "") & (core != ""), F.concat(core, F.lit("에 관해 "), told, F.lit(" 판단한 사례."))),
                (told != "", F.concat(told, F.lit(" 판단한 사례."))),
                (x["declares"] & (x["topic"] != ""), F.concat(x["topic"], F.lit(" 논점 확인 사례."))),
                (~x["declares"] & (core != ""), F.concat(core, object_particle(core), F.lit(" 다툰 판례."))),
            ],
            F.lit("핵심 쟁점이 정리된 판례이다."),
        )
        named = F.when(x["name"] == "", F.lit(None).cast("string")).when(x["name"].endswith("사건"), F.concat(x["name"], F.lit("."))).otherwise(F.concat(x["name"], F.lit(" 사건.")))
        return F.concat_ws(" ", F.when(x["label"] != "", F.concat(F.lit("["), x["label"], F.lit("]"))), named, tail)

    core = issue_core(issue)
    about = F.coalesce(F.nullif(core, F.lit("")), issue)
    given = F.struct(core.alias("core"), verdict(holding).alias("verdict"), declares(about).alias("declares"), compact_topic(issue).alias("topic"), strip(label).alias("label"), F.left(strip(name), F.lit(40)).alias("name"))
    return card_truncate(let(given, line), limit, ("다.", "다 ", "요.", "임.", "니다.", "였다.", "한다.", "된다.", "이다."))


def first_sentence(answer: Column) -> Column:
    """The one sentence of an answer that stands for it: a single line that tells a case, the
    conclusion, the first line that ends as a sentence, the first that is no scaffold."""

    def tells(line: Column) -> Column:
        return any_of(line, ANSWER_ENDINGS) | ends_with(line, ("다", "요"))

    def pick(x: Column) -> Column:
        lines = x["lines"]
        whole = F.when(any_of(x["t"], ("판례이다", "판단한 판례")) & (F.size(lines) == 1), F.get(lines, F.lit(0)))
        told = F.filter(F.transform(F.filter(lines, lambda s: s.rlike("^(- )?결론:")), lambda s: F.regexp_replace(s, r"(?U)^[-\s]*결론\s*:\s*", "")), lambda s: s != "")
        said = F.filter(lines, lambda s: ~s.rlike(r"^[-\[]") & tells(s))
        other = F.filter(lines, lambda s: ~s.rlike("^- (사건|쟁점|결론|복습):"))
        first = lambda a: F.get(a, F.lit(0))
        return F.coalesce(whole, first(told), first(said), first(other), F.replace(x["t"], F.lit("\n"), F.lit(" ")))

    lines = lambda t: F.filter(F.transform(F.split(t, r"\r\n|[\n\r]"), strip), lambda s: s != "")
    return let(strip(answer), lambda t: let(F.struct(t.alias("t"), lines(t).alias("lines")), pick))


# ---- statements that are true or false ------------------------------------------------------------------------------
def single_statement(text: Column) -> Column:
    """The first of merged statements: up to a line end, a polarity mark or an ending with
    something after it."""

    def cut(t: Column) -> Column:
        def up_to(mark: str) -> Column:
            return F.regexp_extract(t, rf"(?s)^(.*?{re.escape(mark)})", 1)

        def more(mark: str) -> Column:
            return strip(F.regexp_extract(t, rf"(?s)^.*?{re.escape(mark)}(.*)$", 1)) != ""

        line = strip(F.regexp_extract(t, r"^([^\n]*)\n", 1))
        cases = [(F.length(line) >= 12, line)]
        cases += [(more(m) & (F.length(strip(up_to(m))) >= 12), strip(up_to(m))) for m in POLARITY_MARKS]
        cases += [(more(m) & (F.length(strip(up_to(m))) >= 14), strip(up_to(m))) for m in STATEMENT_ENDS]
        return first_case(cases, t)

    return let(strip(text), cut)


def sanitize_statement(text: Column) -> Column:
    """One statement for a question of true or false, free of headers, sources and pronouns."""
    statute = r"(제\s*\d+\s*조(?:\s*제\s*\d+\s*항)?(?:\s*제\s*\d+\s*호)?\s*,?\s*){3,}"
    out = strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), "(?U)" + statute, "핵심 조문 "))
    # --- fixed values: headers and sources around a statement ---
    for pattern in (
        r"^자\s+\d{2,4}[가-힣]{1,3}\d+\s*(결정|판결)?\s*", r"^\[[^\]]*\]\s*", r"^[<〈][^>〉]*[>〉]\s*", r"\s*\[\s*공\s*\d{4}[^\]]*\]?\s*$",
        r"\s*\(\s*공\s*\d{4}[^)]*\)?\s*$", r"\s*\[제\s*\d{4}-\d+호?\]?\s*$", r"\s*\[[^\]]{0,40}$", "[<〈>〉]",
    ):
        out = F.regexp_replace(out, "(?U)" + pattern, "")
    out = let(strip(out), lambda t: first_case([(t.rlike("(?U)" + p), F.regexp_replace(t, "(?U)" + p, by)) for p, by in TOPIC_ASSERTIONS], t))
    out = drop_head(let(out, asserted), PARTICLES)
    return F.left(resolve_pronouns(single_statement(out)), F.lit(STATEMENT_LIMIT))


def negate_statement(statement: Column, case_name: Column) -> Column:
    """The statement turned round where one phrase allows it; else a denial of the whole."""

    def who(n: Column) -> Column:
        return F.when((n == "") | n.startswith("OCR-") | n.rlike("^" + CASE_NUMBER.replace(r"\s*", "") + "$"), F.lit("위 판례")).otherwise(F.concat(F.lit("『"), n, F.lit("』")))

    denial = F.concat(let(strip(case_name), who), F.lit("의 실제 결론은 이와 다르다: "), statement)
    flips = [(F.contains(statement, F.lit(yes)) & ~F.contains(statement, F.lit(no)), F.replace(statement, F.lit(yes), F.lit(no))) for yes, no in SAFE_FLIPS]
    return F.left(first_case(flips, denial), F.lit(STATEMENT_LIMIT))


def useful_statement(statement: Column) -> Column:
    """Whether a made statement can be asked."""
    # --- fixed values: what prompts leave in their answers ---
    echoes = ("진술 1", "진술 2", "<문항", "<o 또는", "한국어 진술", "statement:")

    def test(t: Column) -> Column:
        return F.length(t).between(8, 96) & ~raw_fragment(t) & ~broken_text(t) & (F.regexp_count(t, F.lit(r"(?U)제\s*\d+\s*조")) < 4) & ~any_of(F.lower(t), ("portal.scourt", "http", *echoes))

    return let(strip(statement), test)
