"""Cleaning of scanned lines and merging of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statements import strip
from ..functions.text import let

# --- fixed values: lines that are noise of a scan ------------------------------------------
NOISE_PATTERNS = (
    r"^https?://",
    r"^www\.",
    r"^\d{1,2}:\d{2}$",
    r"^\d{1,3}\s*/\s*\d{1,3}$",
    r"^[-—]\s*\d{1,4}\s*[-—]$",
    r"^(?i:p\.?|page)\s*\d+$",
    r"^.?$",
    r"^[\d\s.\-:_/]{1,12}$",
    r"^(?=.{1,50}$).*portal\.scourt\.go\.kr",
    r"^상세내용 안에 있는 표나 도형 등이 제대로 표시가 되지 않을 경우",
)
NOISE_LINES = (
    "대법원 종합법률정보", "판례 검색", "판례검색", "종합법률정보", "대한민국 법원", "법제처", "국가법령정보센터", "PDF로 보기", "판결 내용은 붙임과 같습니다.",
)
# --- fixed values: marks of title pages and of sections -------------------------------------
TITLE_MARKS = (
    (r"(대법원|헌법재판소|고등법원|지방법원).*(선고|결정)", 4),
    (r"\d{2,4}\s*[가-힣]{1,3}\s*\d+", 3),
    (r"전원합의체", 2),
    (r"^\[\s*[가-힣·]{2,20}\s*\]$", 2),
    (r"^[〈<].{4,80}사건[〉>]$", 2),
)
SECTION_MARK = r"판시사항|판결요지|결정요지|참조조문|참조판례|전문|이유|주문"
# --- fixed values: when the last line of a page and the first of the next are one sentence -----
ENDS = (".", "?", "!", "。", "다", "라", "요", "오", "음", "임", "함", "사례", "사례.", "기각한다", "파기한다")
HEAD = r"[【\[]?\s*(판시사항|판결요지|결정요지|참조조문|참조판례|이\s*유|주\s*문)"
ITEM = r"(\[\d+\]|\(\d+\)|\d{1,2}\.\s|[가-힣]\.\s)"
GOES_ON = (
    "는 ", "은 ", "이 ", "가 ", "을 ", "를 ", "에 ", "에서 ", "으로 ", "로 ", "및 ", "또는 ", "그리고 ", "그러나 ", "다만 ", "한편 ",
    "하는 ", "되는 ", "있는 ", "없는 ", "한 ", "된 ", "여부", "(적극)", "(소극)",
)
OPEN = (
    "및", "또는", "그리고", "그러나", "는", "은", "이", "가", "을", "를", "의", "에", "에서", "하여", "되어", "있어", "없어",
    "하고", "되고", "있고", "없고", "하며", "되며", "있으며", "없으며",
)
LINE_END = r"[\n\r\x0B\f\x85\u2028\u2029]"
KEY_LENGTH = 6  # shorter lines may repeat

_NOISE = re.compile("|".join(NOISE_PATTERNS))


def is_noise(line: Column) -> Column:
    s = strip(line)
    return s.rlike("(?U)" + "|".join(NOISE_PATTERNS)) | s.isin(*NOISE_LINES)


def line_key(line: Column) -> Column:
    """A line without its white space, in lower case."""
    return F.lower(F.regexp_replace(line, r"(?U)\s", ""))


def clean_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Each document without noise lines and without lines it had before (shorter ones than
    KEY_LENGTH may repeat); a document of which nothing is left has the empty text. Lines of a
    document are sorted by key and back again, so nothing is shuffled."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), LINE_END), strip)
    keyed = F.transform(F.filter(lines, lambda x: ~is_noise(x)), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("at"), x.alias("line")))

    def first_ones(sorted_lines: Column) -> Column:
        new = lambda x, i: (F.length(x["key"]) < KEY_LENGTH) | (i == 0) | (x["key"] != F.get(sorted_lines, i - 1)["key"])
        kept = F.transform(F.filter(sorted_lines, new), lambda x: F.struct(x["at"], x["line"]))
        return F.array_join(F.transform(F.sort_array(kept), lambda x: x["line"]), "\n")

    return docs.select(doc, let(F.sort_array(keyed), first_ones).alias(text))


def collapse_repeats(lines: DataFrame, doc: str, at: str, line: str) -> DataFrame:
    """Lines that differ from the one before them in their document."""
    before = F.lag(line_key(F.col(line))).over(Window.partitionBy(doc).orderBy(at))
    return lines.withColumn("__before", before).filter(~F.col("__before").eqNullSafe(line_key(F.col(line)))).drop("__before")


def drop_page_headers(lines: DataFrame, doc: str, page: str, line: str) -> DataFrame:
    """Lines of KEY_LENGTH or more are kept on the first page that has them, there as often
    as they occur."""
    keyed = lines.withColumn("__key", line_key(F.col(line)))
    keyed = keyed.withColumn("__first", F.min(page).over(Window.partitionBy(doc, "__key")))
    return keyed.filter((F.length("__key") < KEY_LENGTH) | (F.col(page) == F.col("__first"))).drop("__key", "__first")


# ---- pages of one document, in order: a fold, so plain Python inside Arrow batches ---------
def joins(tail: str, head: str) -> bool:
    """Whether the last line of a page and the first of the next are one sentence."""
    tail, head = tail.strip(), head.strip()
    if not tail or not head or tail.endswith(ENDS) or re.search(rf"^{HEAD}\s*[】\]]?\s*$", tail) or re.match(HEAD, head) or re.match(ITEM, head):
        return False
    if head.startswith(GOES_ON) or tail.endswith(OPEN):
        return True
    return tail[-1] not in ")]】" and head[0] not in "【[(0123456789" and len(tail) >= 8 and len(head) >= 4


def _title(lines: list[str]) -> bool:
    sections = sum(bool(re.search(SECTION_MARK, x)) for x in lines)
    return sections <= 1 and sum(w for x in lines for p, w in TITLE_MARKS if re.search(p, x)) >= 6


def merged(pages: list[str]) -> str:
    """Pages as one text: noise dropped, title pages in front unless the first is one,
    headers of later pages dropped, sentences over page ends joined, repeats collapsed."""
    split = [[s for x in re.split(LINE_END, p) if (s := x.strip()) and not _NOISE.search(s) and s not in NOISE_LINES] for p in pages]
    if split and not _title(split[0]):
        split.sort(key=lambda lines: not _title(lines))  # stable
    key = lambda x: re.sub(r"\s", "", x).lower()
    first: dict[str, int] = {}
    out: list[str] = []
    for number, lines in enumerate(filter(None, split)):
        kept = [x for x in lines if len(key(x)) < KEY_LENGTH or first.setdefault(key(x), number) == number]
        if number and kept and joins(out[-1] if out else "", kept[0]):
            out[-1] += " " + kept.pop(0)
        out += kept
    return "\n".join(x for i, x in enumerate(out) if not i or key(x) != key(out[i - 1]))


def merge_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, text): the pages of each document merged in their order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    grouped = pages.groupBy(doc).agg(F.transform(ordered, lambda x: x["t"]).alias("pages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({doc: b[doc], text: [merged(list(p)) for p in b["pages"]]})

    return grouped.mapInPandas(run, f"{doc} {pages.schema[doc].dataType.simpleString()}, {text} string")
