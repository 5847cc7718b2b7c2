"""The parser of judgments against a plain one, text by text."""

import random
import re

import pytest

from quillspark.operators import judgment
from quillspark.operators.judgment import ACTS, BRACKETS, OPINIONS, POLARITIES, SECTIONS, SPACED

PRECEDENT = re.compile(judgment.PRECEDENT)
_NAME = "|".join(r"\s*".join(s) if s in SPACED else s for s in sorted(SECTIONS, key=len, reverse=True))
_MARKER = re.compile("|".join([*(rf"{re.escape(a)}\s*(?:{_NAME})\s*{re.escape(b)}" for a, b in BRACKETS), rf"(?:^|\n)\s*(?:{_NAME})\s*[:：]?\s*(?=\n)"]))
_OPINION = re.compile(r"\[\s*([^\]]*?(?:다수의견|반대의견|보충의견|별개의견))\s*\]")


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace(" ", " ")).strip()


def first_of(text: str, table, otherwise: str) -> str:
    return next((name for mark, name in table if mark in text), otherwise)


def sections(text: str) -> dict[str, str]:
    """Bodies by section name; of repeated sections the longest."""
    marks = list(_MARKER.finditer(text))
    found: dict[str, str] = {}
    for m, stop in zip(marks, [*(m.start() for m in marks[1:]), len(text)]):
        name, body = re.sub(r"[\s:：【】\[\]〔〕<>]", "", m[0]), text[m.end() : stop]
        if len(body) > len(found.get(name, "")) or name not in found:
            found[name] = body
    return found


def numbered(body: str) -> list[str]:
    """Items after [1], [2], ...; the whole body if there are none."""
    parts = re.split(r"\[\s*\d+\s*\]", body)
    items = [p.strip() for p in parts[1:] if p.strip()]
    return items or [body]


def clauses(issue: str) -> list[str]:
    """Sub-issues between slashes that stand between Hangul (or a closing bracket) and Hangul;
    parts of six characters or more, or the whole issue."""
    parts = [p.strip() for p in re.split(r"(?<=[가-힣)])\s*/\s*(?=[가-힣])", issue)]
    kept = [p for p in parts if len(p) >= 6]
    return kept or [issue]


def digest_issues(body: str) -> list[tuple[str, str]]:
    """Issues of a bulleted digest: of question and answer the answer; with polarity."""
    parts = re.split(r"(?m)^\s*○\s*", body)
    items = [p for p in parts[1:] if p.strip()] or [body]
    out = []
    for item in items:
        text = re.sub(r"^\(?\s*쟁점\s*[①-⑩0-9]+\s*\)?\s*", "", squeeze(item))
        question, *rest = re.split(r"\s*[-–—]\s*", text, maxsplit=1)
        answer = rest[0].strip() if rest else ""
        chosen = answer or question.strip()
        if len(chosen) >= 8:
            polarity = first_of(question, POLARITIES, "unknown")
            out.append((chosen, polarity if polarity != "unknown" else first_of(answer, POLARITIES, "unknown")))
    return out


def holdings(body: str) -> list[tuple[int, str, str]]:
    """(issue, opinion, text): numbered items, each cut at its opinions."""
    out = []
    for number, item in enumerate(numbered(body), 1):
        parts = _OPINION.split(item)
        if len(parts) == 1:
            out.append((number, "unspecified", squeeze(item)))
        for label, text in zip(parts[1::2], parts[2::2], strict=True):
            if squeeze(text):
                out.append((number, first_of(label, OPINIONS, "unspecified"), squeeze(text)))
    return out


def acts(text: str) -> list[str]:
    """Known acts in a text, compared without white space, longer names first."""
    bare = re.sub(r"\s+", "", text)
    return [a for a in sorted(ACTS, key=len, reverse=True) if a.replace(" ", "") in bare]


def parse(text: str | None) -> tuple:
    found = sections(text or "")
    if found.get("판시사항"):
        issues = [(c, first_of(c, POLARITIES, "unknown")) for item in numbered(found["판시사항"]) for c in clauses(squeeze(item))]
    else:
        issues = digest_issues(found["요지"]) if found.get("요지") else []
    held = holdings(found.get("판결요지") or found.get("결정요지")) if found.get("판결요지") or found.get("결정요지") else []
    statutes = squeeze(found.get("참조조문", ""))
    precedents = list(dict.fromkeys(m.replace(" ", "") for m in PRECEDENT.findall(found.get("참조판례", ""))))
    return [i for i, _ in issues], [p for _, p in issues], held, statutes, acts(statutes), precedents, "이유" in found, any(o != "unspecified" for _, o, _ in held)


PIECES = [
    "【판시사항】", "[ 판결요지 ]", "〔결 정요지〕", "<참조조문>", "【참조판례】", "\n이 유\n", "\n 주문 :\n", "【요 지】", "[1]", "[ 2 ]", "[다수의견]", "[대법관 가의 반대의견]", "[별개의견 ]", "\n○ ", "\n  ○ (쟁점 ①) ", " - ", "—",
    "영장 없는 압수의 적법 여부(소극)", "가능한지 / 그렇지 않은지 여부", "(한정적극)", "(적극)", "짧다", " ", "\n", "\n\n", "형사 소송법 제308조", "헌법", "마약류관리에 관한 법률", "2012도 1234", "2012도1234 판결", "98헌마5", "그 증거는 위법하다고 본다.",
    "판시사항", "이유", "a/b", "가/나다라마바사", ") / 증거능력의 유무",
]


@pytest.mark.parametrize("seed", range(4))
def test_random_judgments(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(300)] + [None, "", "【판시사항】", "x" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    filled = 0
    for r in judgment.parse_judgments(docs, "id", "text").collect():
        want = parse(texts[r.id])
        got = (r.issues, r.polarities, [tuple(h) for h in r.holdings], r.statutes, r.acts, r.precedents, r.has_reasoning, r.has_opinions)
        assert got == want, texts[r.id]
        filled += bool(r.issues) and bool(r.holdings)
    assert filled > 10


def test_digests_and_roles_need_no_join(spark):
    """A parsed judgment keeps its text, and a digest its judgment: nothing is shuffled, and rows without an id stay."""
    from quillspark.operators import digest

    docs = spark.createDataFrame([(1, "【판시사항】\n[1] 영장 없이 압수한 증거의 증거능력이 인정되는지 여부(소극)\n【판결요지】\n[1] 증거능력이 인정되지 않는다.\n"), (None, "사 건\n2024도4422 절도\n")], "id long, text string")
    parsed = judgment.parse_judgments(docs, "id", "text", ["text"])
    for made in (digest.sentence_roles(parsed, "id", "text"), digest.digest(parsed, "id", "text")):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == 2
