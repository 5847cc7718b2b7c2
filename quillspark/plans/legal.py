"""Queries over judgments: the driver's documents, each with a judgment in front of its text, and
cards, statements, reviews and experiments over the other tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statements as S
from ..functions import text as X
from ..functions import vocab
from ..operators import clean, device, digest, experiment, judgment, quiz, review
from ..sources.files import concat_corpora
from ..sources.tables import table
from .text import word_vectors
from .text_sql import NORMAL, quoted, rows, study_classes, texts

# Judgments put in front of the driver's texts, one by doc_id modulo their count.
JUDGMENTS = (
    "[모해위증]\n대법원 2020. 5. 14. 선고 2019도12345 판결\n【판시사항】\n[1] 공범인 공동피고인이 소송절차의 분리로 피고인의 지위에서 벗어나면 증인이 될 수 있는지 여부(적극)\n"
    "[2] 피고인이 위증죄로 기소된 사안에서, 증언거부권이 고지되지 않았더라도 원심판결에 법리오해의 잘못이 없다고 한 사례\n【판결요지】\n[1] [다수의견] 공범인 공동피고인은 소송절차가 분리되면 다른 공동피고인에 대한 공소사실에 관하여 증인이 될 수 있다. "
    "이는 위증죄의 요건에 해당한다.\n[2] 피고인이 증언한 이 사건에서 원심의 판단은 정당하다.\n【참조조문】 형법 제152조, 형사소송법 제148조\n【참조판례】 대법원 2008도3300\n【이 유】\n",
    "사 건\n2024도4422 성폭력범죄의처벌등에관한특례법위반\n【판시사항】\n[1] 통신매체이용음란죄에서 '통신매체'의 의미 및 전자금융거래의 '송금메모'가 이에 해당하는지 여부(적극)\n【판결요지】\n"
    "[1] '통신매체'는 전화, 우편, 컴퓨터 그 밖의 매체를 의미한다. 송금메모는 이에 해당한다.\n【참조조문】 성폭력범죄의 처벌 등에 관한 특례법 제13조\n주 문\n\n상고를 기각한다.\n비용은 피고인이 부담한다.\n이 유\n",
    "【판시사항】\n[1] 수사기관이 영장 없이 압수한 증거의 증거능력이 인정되는지 여부(소극)\n【판결요지】\n[1] 영장 없이 압수한 물건은 위법수집증거로서 증거능력이 인정되지 않는다.\n【참조조문】 형사소송법 제308조의2\n【이 유】\n",
    "〈담보공탁금이 손해를 담보하 는지가 문제 된 사건〉\n2025마8671 결정\n공탁금이 담보하는 손해의 범위를 판단하는 기준이 문제 된 사건이다. 담보공탁금은 그 손해를 담보하는 것으로 위법하다고 볼 수 없다. 원심을 파기하고 사건을 환송한다.\n",
    "헌법재판소는 표현의 자유를 제한하는 조항이 과잉금지원칙에 위반되는지 심사하였다. 최소침해와 법익균형을 갖추지 못하여 위헌이다. 기본권을 침해하는 조항은 허용되지 않는다.\n",
    "징계위원회의 구성과 소청심사의 기한을 정한 규정. 정보공개 결정은 행정처분에 해당한다. 08경 00경부터 처분의 취소를 구하였다.\n",
)
HOLDINGS = ("원심판결은 위법하다고 본다.", "상고를 기각한다.", "구성요건에 해당하지 않는다.", "조항은 헌법불합치이다.", "아무 결론도 없다.", "범죄가 성립한다고 판단한다.")
TOPICS = ("송금메모", "통신매체", "영장주의", "위법수집증거", "손해배상", "재량권")


def _pick(values, key: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def judgments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.concat(_pick(JUDGMENTS, "doc_id"), F.coalesce("text", F.lit(""))).alias("text"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return judgment.parse_judgments(judgments(spark, d), "doc_id", "text", ["text"])


def joined(values: str) -> Column:
    return F.array_join(values, " | ").alias(values)


# ---- extraction and digests ------------------------------------------------------------------------
def device_keyphrases(spark: SparkSession, d: str) -> DataFrame:
    clean = device.normalize(judgments(spark, d), "doc_id", "text")
    return clean.select("doc_id", F.array_join(device.keyphrases(F.col("text"), 10), ",").alias("phrases"))


def device_sentences(spark: SparkSession, d: str) -> DataFrame:
    clean = device.normalize(judgments(spark, d), "doc_id", "text")
    return clean.select("doc_id", device.key_sentences(F.col("text"), 4).alias("sentences"))


# Parts of judgments, each chosen by another modulus of the document's number.
KINDS = ("도", "다", "누", "헌마", "모")
LAWS = ("형법", "형사소송법", "민법", "행정소송법", "헌법재판소법", "마약류 관리에 관한 법률", "도로교통법")
ASPECTS = ("고의와 과실", "영장 없는 압수", "손해배상의 범위", "처분의 취소", "과잉금지원칙", "증거능력", "기본권의 제한", "보이스피싱", "구성요건")
ENDS = ("적극", "소극", "한정 적극")
PARTS = ("f", "k", "m", "p", "q")
TEMPLATE = "사 건\n{year}{kind}{number}\n【판시사항】\n[1] {law} 제{article}조에서 정한 {aspect}의 의미({end})\n【판결요지】\n[1] {other}에 관한 판단은 정당하다.\n【참조조문】 {law} 제{article}조\n이 유\n"


def composed_judgments(spark: SparkSession, d: str) -> DataFrame:
    """Judgments put together from parts in front of the documents' texts."""
    k = F.col("doc_id")
    of = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    parts = {
        "year": (F.lit(1990) + k % 31).cast("string"), "kind": of(KINDS, F.floor(k / 2)), "number": (k * 37 % 9973).cast("string"), "law": of(LAWS, k), "article": (k * 11 % 400 + 1).cast("string"),
        "aspect": of(ASPECTS, F.floor(k / 3)), "end": of(ENDS, F.floor(k / 5)), "other": of(ASPECTS, F.floor(k / 7) + 4),
    }
    pieces = [parts[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", TEMPLATE)]
    return table(spark, d, "documents").select("doc_id", F.concat(*pieces, F.coalesce("text", F.lit(""))).alias("text"))


def _composed_sql() -> str:
    of = lambda values, by: f"list_extract({texts(values)}, (({by}) % {len(values)} + 1)::BIGINT)"
    parts = {
        "year": "(1990 + doc_id % 31)::VARCHAR", "kind": of(KINDS, "doc_id // 2"), "number": "(doc_id * 37 % 9973)::VARCHAR", "law": of(LAWS, "doc_id"), "article": "(doc_id * 11 % 400 + 1)::VARCHAR",
        "aspect": of(ASPECTS, "doc_id // 3"), "end": of(ENDS, "doc_id // 5"), "other": of(ASPECTS, "doc_id // 7 + 4"),
    }
    pieces = [parts[p[1:-1]] if p.startswith("{") else quoted(p) for p in re.split(r"(\{\w+\})", TEMPLATE)]
    return f"kd AS (SELECT doc_id, {' || '.join(pieces)} || coalesce(text, '') AS text FROM documents)"


OPEN, CLOSE = ("【", "[", "〔", "<"), ("】", "]", "〕", ">")
# Sections of judgments: each piece stands where its condition on the document's number holds.
PIECES = (
    ("true", "사 건\n{year}{kind}{number}\n"),
    ("doc_id % 7 <> 3", "{open}판시사항{close}\n[1] {aspect}의 의미({end}) / {other}에 관한 판단 기준(한정 소극)\n"),
    ("doc_id % 7 <> 3 and doc_id % 3 > 0", "[ 2 ] {other}의  성립 여부\n"),
    ("doc_id % 7 = 3", "{open}요 지{close}\n○ (쟁점 ①) {aspect}이 문제되는지({end}) - {other}을 인정할 수 있다\n○ {other}의 성립 여부(소극)\n"),
    ("doc_id % 5 < 3", "{open} 판결요지 {close}\n"),
    ("doc_id % 5 >= 3", "{open}결정요지{close}\n"),
    ("doc_id % 2 = 0", "[1] [다수의견] {aspect}을 인정한다. [대법관 {number}의 반대의견] {other}이 없다.\n"),
    ("doc_id % 2 = 1", "[1] {aspect}에 관한 원심의 판단은 정당하다.\n"),
    ("doc_id % 3 = 2", "[2] [ 별개의견 ] {other}도 살펴야 한다.\n"),
    ("true", "{open}참조조문{close} {law} 제{article}조,  {law2} 제12조\n"),
    ("doc_id % 4 < 3", "{open}참조판례{close} 대법원 {year}도 {number} 판결, {year}도{number}, {year}헌마{article}\n"),
    ("doc_id % 6 > 0", "\n이 유\n"),
)


def _numbers(sql: bool) -> dict[str, str]:
    """The parts of a document's judgment as expressions of either SQL."""
    div = (lambda n: f"doc_id // {n}") if sql else (lambda n: f"doc_id div {n}")
    pick = (lambda vs, by: f"list_extract({texts(vs)}, (({by}) % {len(vs)} + 1)::BIGINT)") if sql else (lambda vs, by: f"get(array({', '.join(map(quoted, vs))}), int(({by}) % {len(vs)}))")
    return {
        "year": "cast(1990 + doc_id % 31 as string)", "kind": pick(KINDS, div(2)), "number": "cast(doc_id * 37 % 9973 as string)", "law": pick(LAWS, "doc_id"), "law2": pick(LAWS, div(3)),
        "article": "cast(doc_id * 11 % 400 + 1 as string)", "aspect": pick(ASPECTS, div(3)), "end": pick(ENDS, div(5)), "other": pick(ASPECTS, f"{div(7)} + 4"), "open": pick(OPEN, div(4)), "close": pick(CLOSE, div(4)),
    }


def _sectioned(sql: bool) -> str:
    """The sectioned judgment of a document, its text at the end."""
    parts = _numbers(sql)
    quote = quoted if sql else (lambda v: quoted(v).replace("\n", "\\n"))
    piece = lambda template: " || ".join(parts[p[1:-1]] if p.startswith("{") else quote(p) for p in re.split(r"(\{\w+\})", template) if p)
    return " || ".join(f"case when {test} then {piece(template)} else '' end" for test, template in PIECES) + " || coalesce(text, '')"


def judgment_parts(spark: SparkSession, d: str) -> DataFrame:
    """The structure of judgments whose sections vary with the document's number."""
    docs = table(spark, d, "documents").select("doc_id", F.expr(_sectioned(False)).alias("text"))
    found = judgment.parse_judgments(docs, "doc_id", "text")
    held = F.transform("holdings", lambda h: F.concat_ws(":", h["issue_no"].cast("string"), h["opinion"], h["text"]))
    lists = {"issues": F.col("issues"), "polarities": F.col("polarities"), "holdings": held, "acts": F.col("acts"), "precedents": F.col("precedents")}
    return found.select("doc_id", *(F.array_join(c, " | ").alias(n) for n, c in lists.items()), "statutes", F.col("has_reasoning").cast("long").alias("has_reasoning"), F.col("has_opinions").cast("long").alias("has_opinions"))


def _judgment_sql() -> str:
    strip_ = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    squeeze_ = lambda x: strip_(f"regexp_replace({x}, '\\s+', ' ', 'g')")
    first = lambda x, pairs: "CASE " + " ".join(f"WHEN contains({x}, {quoted(m)}) THEN {quoted(n)}" for m, n in pairs)
    marker = judgment.MARKER.replace(r"\s*(?=\n)", r"\s*\n")  # what follows is stripped
    body = lambda name: f"list_filter(ss, lambda s: s.name = {quoted(name)})[1].body"
    items = lambda b: f"(SELECT CASE WHEN len(xs) > 0 THEN xs ELSE [{b}] END FROM (SELECT list_filter(list_transform(string_split_regex({b}, '\\[\\s*\\d+\\s*\\]')[2:], lambda i: {strip_('i')}), lambda i: i <> '') AS xs))"
    known = f"{texts(sorted(judgment.ACTS, key=len, reverse=True))}"
    cut = f"list_transform(string_split(regexp_replace(i, '([가-힣)])\\s*/\\s*([가-힣])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda c: {strip_('c')})"
    return f"""WITH j AS (SELECT doc_id, {_sectioned(True)} AS t FROM documents),
        m AS (SELECT doc_id, list_transform(regexp_extract_all(t, {quoted(marker)}), lambda x: regexp_replace(x, '[\\s:：【】\\[\\]〔〕<>]', '', 'g')) AS names, string_split_regex(t, {quoted(marker)})[2:] AS bodies FROM j),
        s AS (SELECT doc_id, list_transform(list_zip(names, bodies), lambda z: {{'name': z[1], 'body': z[2]}}) AS ss FROM m),
        b AS (SELECT doc_id, {body("판시사항")} AS asked, {body("요지")} AS digest, coalesce({body("판결요지")}, {body("결정요지")}) AS held, coalesce({body("참조조문")}, '') AS laws, coalesce({body("참조판례")}, '') AS cases,
          (len(list_filter(ss, lambda s: s.name = '이유')) > 0)::BIGINT AS has_reasoning FROM s),
        i0 AS (SELECT doc_id, unnest(xs) AS i, unnest(range(len(xs))) AS k FROM (SELECT doc_id, list_transform({items("asked")}, lambda i: {squeeze_("i")}) AS xs FROM b WHERE asked <> '')),
        i1 AS (SELECT doc_id, k, unnest(xs) AS x, unnest(range(len(xs))) AS l FROM (SELECT doc_id, k, CASE WHEN len(list_filter({cut}, lambda c: length(c) >= 6)) > 0 THEN list_filter({cut}, lambda c: length(c) >= 6) ELSE [i] END AS xs FROM i0)),
        i2 AS (SELECT doc_id, string_agg(x, ' | ' ORDER BY k, l) AS issues, string_agg({first("x", judgment.POLARITIES)} ELSE 'unknown' END, ' | ' ORDER BY k, l) AS polarities FROM i1 GROUP BY doc_id),
        g0 AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS k FROM (SELECT doc_id, list_filter(string_split_regex(digest, '(?m)^\\s*○\\s*')[2:], lambda x: {strip_("x")} <> '') AS xs FROM b WHERE digest <> '')),
        g1 AS (SELECT doc_id, k, string_split_regex(regexp_replace({squeeze_("x")}, '^\\(?\\s*쟁점\\s*[①-⑩0-9]+\\s*\\)?\\s*', ''), '\\s*[-–—]\\s*') AS p FROM g0),
        g2 AS (SELECT doc_id, k, p[1] AS q, {strip_("coalesce(array_to_string(p[2:], '-'), '')")} AS a FROM g1),
        g3 AS (SELECT doc_id, string_agg(CASE WHEN a <> '' THEN a ELSE {strip_("q")} END, ' | ' ORDER BY k) AS issues, string_agg({first("q", judgment.POLARITIES)} ELSE {first("a", judgment.POLARITIES)} ELSE 'unknown' END END, ' | ' ORDER BY k) AS polarities
          FROM g2 WHERE length(CASE WHEN a <> '' THEN a ELSE {strip_("q")} END) >= 8 GROUP BY doc_id),
        h0 AS (SELECT doc_id, unnest(xs) AS i, unnest(range(len(xs))) + 1 AS k FROM (SELECT doc_id, {items("held")} AS xs FROM b WHERE held <> '')),
        h1 AS (SELECT doc_id, k, i, regexp_extract_all(i, {quoted(judgment.OPINION)}, 1) AS labels, string_split_regex(i, {quoted(judgment.OPINION)})[2:] AS told FROM h0),
        h2 AS (SELECT doc_id, k, unnest(labels) AS label, unnest(told) AS x, unnest(range(len(labels))) AS l FROM h1 WHERE len(labels) > 0 UNION ALL SELECT doc_id, k, '', i, 0 FROM h1 WHERE len(labels) = 0),
        h3 AS (SELECT doc_id, k, l, {first("label", judgment.OPINIONS)} ELSE 'unspecified' END AS opinion, {squeeze_("x")} AS x, label FROM h2),
        h4 AS (SELECT doc_id, string_agg(k || ':' || opinion || ':' || x, ' | ' ORDER BY k, l) AS holdings, max((opinion <> 'unspecified')::BIGINT) AS has_opinions FROM h3 WHERE x <> '' OR label = '' GROUP BY doc_id),
        c0 AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS k FROM (SELECT doc_id, list_transform(regexp_extract_all(cases, {quoted(judgment.PRECEDENT)}), lambda x: replace(x, ' ', '')) AS xs FROM b)),
        c1 AS (SELECT doc_id, string_agg(x, ' | ' ORDER BY k) AS precedents FROM (SELECT doc_id, x, min(k) AS k FROM c0 GROUP BY doc_id, x) GROUP BY doc_id),
        l AS (SELECT doc_id, {squeeze_("laws")} AS statutes, regexp_replace(laws, '\\s+', '', 'g') AS bare FROM b)
        SELECT b.doc_id, coalesce(i2.issues, g3.issues, '') AS issues, coalesce(i2.polarities, g3.polarities, '') AS polarities, coalesce(holdings, '') AS holdings,
          array_to_string(list_filter({known}, lambda a: contains(bare, replace(a, ' ', ''))), ' | ') AS acts, coalesce(precedents, '') AS precedents, statutes, has_reasoning, coalesce(has_opinions, 0) AS has_opinions
        FROM b LEFT JOIN i2 USING (doc_id) LEFT JOIN g3 USING (doc_id) LEFT JOIN h4 USING (doc_id) LEFT JOIN c1 USING (doc_id) LEFT JOIN l USING (doc_id)"""


def device_domains(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    found = composed_judgments(spark, d)
    return found.select("doc_id", device.domain_of_hints(F.col("text"), none).alias("by_hints"), device.domain_of_laws(F.col("text")).alias("by_laws"), digest.digest_domain(none, F.col("text")).alias("for_digest"))


def _domains_sql() -> str:
    """By hints, else the weighted class; by the laws that a text names; for a digest."""
    laws = [(n, name, law) for n, (name, ls) in enumerate(device.NAMED_IN_TEXT) for law in ls]
    hints = [(n, name, h) for n, (name, hs) in enumerate(device.DOMAIN_HINTS.items()) for h in hs]
    special = " OR ".join(f"contains(rest, {quoted(x)})" for x in digest.SPECIAL_LAWS)
    own = "(regexp_matches(t, '형법(제|상|총칙|각칙)') OR NOT contains(t, '형사소송법'))"
    return f"""WITH {_composed_sql()}, {rows("law", "n, domain, l", laws)}, {rows("hint", "n, domain, h", hints)}, {rows("class_domain", "class, domain", list(device.CLASS_DOMAINS.items()))},
        classes AS ({study_classes((), _composed_sql())}),
        x AS (SELECT doc_id, replace(regexp_replace(replace(lower(text || ' '), '헌법재판소', chr(1)), '헌법상|헌법적', ' ', 'g'), chr(1), '헌법재판소') AS t, regexp_replace(text, '\\s+', '', 'g') AS bare FROM kd),
        c AS (SELECT doc_id, domain, n, count(*) AS hits FROM x JOIN hint ON contains(t, h) AND (h <> '형법' OR {own}) GROUP BY ALL),
        b AS (SELECT doc_id, arg_min(domain, n - 100 * hits) AS domain, max(hits) AS hits FROM c GROUP BY doc_id),
        l AS (SELECT doc_id, arg_min(domain, n) AS domain FROM x JOIN law ON contains(bare, l) GROUP BY doc_id),
        r AS (SELECT doc_id, bare, replace(bare, '형사소송법', '') AS rest FROM x),
        g AS (SELECT doc_id, CASE WHEN NOT contains(bare, '형사소송법') THEN l.domain WHEN {special} OR regexp_matches(rest, '형법(제|상|총칙|각칙)') THEN 'criminal_law' ELSE 'criminal_procedure_evidence' END AS domain FROM r LEFT JOIN l USING (doc_id))
        SELECT x.doc_id, coalesce(CASE WHEN hits >= 2 THEN b.domain END, CASE WHEN confidence >= 0.5 THEN d.domain END, {quoted(vocab.GENERAL_DOMAIN)}) AS by_hints, l.domain AS by_laws,
          CASE WHEN g.domain = 'civil_law' THEN 'civil_procedure' ELSE g.domain END AS for_digest
        FROM x LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN classes USING (doc_id) LEFT JOIN class_domain d USING (class)"""


def device_extraction(spark: SparkSession, d: str) -> DataFrame:
    found = device.extract_parsed(_parsed(spark, d), "doc_id", "text")
    return found.select("doc_id", joined("keywords"), "key_sentences", "domain", joined("focus"))


def sentence_roles(spark: SparkSession, d: str) -> DataFrame:
    return digest.sentence_roles(_parsed(spark, d), "doc_id", "text").select("doc_id", joined("issues"), joined("principles"), joined("holdings"), joined("summaries"))


def case_digests(spark: SparkSession, d: str) -> DataFrame:
    return digest.digest(_parsed(spark, d), "doc_id", "text")


def section_flags(spark: SparkSession, d: str) -> DataFrame:
    return judgments(spark, d).select("doc_id", digest.section_flags(F.col("text")).alias("f")).select("doc_id", *[F.col(f"f.{x}").cast("int").cast("long").alias(x) for x in ("issues", "holding", "statutes", "precedents", "reasoning", "opinions")])


def case_facts(spark: SparkSession, d: str) -> DataFrame:
    """Number, court and date that the text of a judgment names first."""
    t = F.col("text")
    return judgments(spark, d).select("doc_id", digest.case_number(t).alias("number"), digest.court(t).alias("court"), digest.decided_on(t).alias("date"))


def scan_keywords(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    words = judgments(spark, d).select("doc_id", digest.scan_keywords(t).alias("keywords"), digest.refine_sentences(F.lit(""), t).alias("refined"), "text")
    return words.select("doc_id", joined("keywords"), "refined", digest.auto_name(F.col("keywords"), F.col("refined")).alias("name"), digest.subject(F.col("text")).alias("subject"))


# ---- statements ---------------------------------------------------------------------------------------
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.verdict(F.concat(_pick(HOLDINGS, "doc_id"), F.coalesce("text", F.lit("")))).alias("verdict"))


def particles(spark: SparkSession, d: str) -> DataFrame:
    """Topics, and names of documents, with the particle that follows them."""
    named = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise(_pick(TOPICS, "doc_id")).alias("word"))
    return named.select("doc_id", F.concat("word", S.object_particle(F.col("word"))).alias("object"), F.concat("word", S.particle(F.col("word"), "은", "는")).alias("topic"))


def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the benchmark and holdings by what they can't be used for."""
    b = table(spark, d, "benchmark").select("item_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _pick((*HOLDINGS, "영장이 필요한지 여부", "그 범위 (적극)", "10초 분기: 암기", "쟁점이 문제된 사건"), "item_id")).alias("text"))
    t = F.col("text")
    flag = lambda c, name: c.cast("int").cast("long").alias(name)
    return b.select("item_id", flag(S.raw_fragment(t), "raw"), flag(S.broken_text(t), "broken"), flag(S.guidance_line(t), "guidance"), flag(S.topic_line(t), "topic"), flag(S.weak_evidence(t), "weak"))


def near_equal(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations that say nearly what the turn before them says."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("previous"))
    both = c.join(before, ["conv_id", "turn"])
    return both.groupBy("conv_id").agg(F.count_if(S.near_equal(F.coalesce("text", F.lit("")), F.coalesce("previous", F.lit("")))).alias("repeated"), F.count("*").alias("turns"))


def shrunk_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.shrink(F.coalesce("text", F.lit("")), 120).alias("short"))


def issue_statements(spark: SparkSession, d: str) -> DataFrame:
    """Issues of judgments as statements, with core, topic and card forms."""
    pairs = _parsed(spark, d).select("doc_id", F.posexplode(F.arrays_zip("issues", "polarities")).alias("at", "x")).select("doc_id", "at", F.col("x.issues").alias("issue"), F.col("x.polarities").alias("polarity"))
    i = F.col("issue")
    return pairs.select(
        "doc_id", F.col("at").cast("long").alias("at"), S.declarative(i, F.col("polarity")).alias("statement"), S.issue_core(i).alias("core"), S.compact_topic(i).alias("topic"), S.canonical_issue(i).alias("canonical"), S.card_text(i, "issue").alias("card"), S.sanitize_statement(i).alias("asked")
    )


def card_texts(spark: SparkSession, d: str) -> DataFrame:
    """Cards of digests: canonical ruling and exam texts, one-line summaries, first sentences."""
    found = case_digests(spark, d)
    answer = F.concat(F.lit("- 사건: "), "case_number", F.lit("\n- 결론: "), "holding")
    return found.select("doc_id", S.canonical_ruling(F.col("holding")).alias("ruling"), S.canonical_exam(F.col("issue")).alias("exam"), S.one_line(F.col("domain"), F.col("subject"), F.col("issue"), F.col("holding")).alias("line"), S.first_sentence(answer).alias("first"))


def truth_items(spark: SparkSession, d: str) -> DataFrame:
    """Questions of true or false, accepted or filled up, hints and the question with options."""
    found = case_digests(spark, d)
    found = found.withColumns({"c_issue": S.canonical_issue(F.col("issue")), "c_holding": S.canonical_ruling(F.col("holding")), "c_exam": F.lit(S.NO_EXAM)})
    none = F.array().cast("array<string>")
    issue, holding, number, name = (F.col(c) for c in ("issue", "holding", "case_number", "subject"))
    cards = [F.col(c) for c in ("c_issue", "c_holding", "c_exam")]
    seeds = quiz.card_seeds(*cards)
    fallback = quiz.truth_items(quiz.evidence_sentences(holding, name), seeds, number, name, 3)
    made = F.array(F.struct(issue.alias("statement"), F.lit(True).alias("answer"), F.lit("").alias("explanation")), F.struct(holding.alias("statement"), F.lit(True).alias("answer"), F.lit("").alias("explanation")))
    evidence = quiz.merged_evidence(*cards, holding, none, name, none)
    out = found.select("doc_id", quiz.accepted_items(made, fallback, 3).alias("items"), quiz.decision_hints(issue, none, F.array(F.lit("영장")), F.col("doc_id")).alias("hints"), quiz.choice_quiz(number, name, F.col("domain"), evidence).alias("choice"))
    show = F.transform("items", lambda x: F.concat(F.when(x["answer"], "O ").otherwise("X "), x["statement"]))
    return out.select("doc_id", F.array_join(show, " | ").alias("items"), joined("hints"), F.array_join("choice.options", " | ").alias("options"), F.array_join("choice.keywords", ",").alias("keywords"))


def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the newest three orders of each customer, packed into lines, and a draft that
    compares them."""
    from ..operators.relational import top_per_group

    o = top_per_group(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 3)
    case = F.struct(
        "rank", F.col("o_orderkey").cast("string").alias("case_number"), F.col("o_orderstatus").alias("case_name"), F.col("o_orderpriority").alias("subject"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issue"), F.lit(None).cast("string").alias("holding"), F.lit("").alias("exam")
    )
    packed = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(case)).alias("cases"))
    return packed.select("o_custkey", quiz.packed_evidence(F.col("cases")).alias("evidence"), quiz.comparison(F.lit("비교"), F.col("cases"), "rules").alias("draft"))


def scanned_rows(spark: SparkSession, d: str) -> DataFrame:
    records = judgments(spark, d).select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, F.lit("2020도1")).alias("case_number"), F.when(F.col("doc_id") % 3 == 0, F.lit("피고인")).otherwise(F.concat(F.lit("사건 "), F.col("doc_id").cast("string"))).alias("case_name"), F.col("text").alias("raw_text"),
        F.array(F.lit("영장"), F.lit("압수"), F.lit("수색"), F.lit("증거")).alias("keywords"), F.when(F.col("doc_id") % 2 == 0, F.lit("쟁점")).alias("key_issue"), F.lit("핵심").alias("key_sentences"), F.lit("결론").alias("ruling_point"), F.lit(None).cast("string").alias("exam_takeaway"),
    )
    return digest.case_rows(records)


def summary_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of keys and values read back, with whole texts as values; every third lacks a key."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"[:\s-]+", " ")
    block = F.concat(F.lit("- 요약: 한 줄 "), F.col("doc_id").cast("string"), F.lit("\n- key_issue: "), t, F.lit("\n이어서\n결론: 판단\n"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("- 시험 포인트: 암기"))
    found = table(spark, d, "documents").select("doc_id", review.parsed_block(block).alias("b"))
    return found.select("doc_id", "b.one_line_summary", F.md5("b.key_issue").alias("key_issue"), "b.ruling_point", "b.exam_takeaway")


# ---- reviews -----------------------------------------------------------------------------------------------
def review_list(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose container isn't the expected one or that have a remark, of a kind of type."""
    p = table(spark, d, "part").withColumn("memo", F.when(F.col("p_size") > 45, F.col("p_name")).otherwise(F.lit(" ")))
    wanted = review.needs_review(F.col("p_brand"), F.lit("Brand#11"), F.col("memo")) & review.same_subject(F.col("p_type"), " ECONOMY ")
    return p.filter(wanted).select("p_partkey", "p_type")


def shown_cases(spark: SparkSession, d: str) -> DataFrame:
    """Nations as shown under another name where the region has one, else as they are."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    shown = table(spark, d, "region").select(F.col("r_regionkey").cast(n.schema["n_nationkey"].dataType).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return review.show_or_self(n, shown, "n_nationkey")


def found_case(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("id"))
    return review.first_match(c, "c_name", "id", "7", [F.col("c_custkey")])


def renamed_cases(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("number"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise(F.col("s_name")).alias("name"))
    return review.rename_to_number(s, "name", "number").select("s_suppkey", "name", F.col("migrated").cast("int").cast("long").alias("migrated"))


def stamped_updates(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.lit("2024-01-01").alias("updated_at"))
    changes = table(spark, d, "region").select(F.col("r_regionkey").cast(n.schema["n_nationkey"].dataType).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return review.update_rows(n, changes, "n_nationkey", "updated_at", F.lit("2025-01-01"))


def stage_log(spark: SparkSession, d: str) -> DataFrame:
    """Steps between stages that aren't allowed, with the kinds of a user's events as stages."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.get(F.array(*map(F.lit, review.STAGES)), (F.col("event_id") % len(review.STAGES)).cast("int")).alias("stage"))
    found = review.stage_violations(e.withColumn("at", F.struct("ts", "event_id")), "user_id", "stage", "at")
    return found.groupBy("before", "after").agg(F.count("*").alias("n"))


def daily_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    daily = review.daily_with_confidence(e, F.to_date("ts"), F.col("event_type") != "error", F.col("event_type"))
    flat = daily.select(F.col("day").cast("string").alias("day"), "solved", "correct", F.explode("confidence").alias("level", "n"))
    return flat


def remaining_time(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").select("event_id", review.remaining(F.col("ts"), F.to_timestamp(F.lit("2024-02-15 12:34:56"))).alias("r"))
    return r.select("event_id", "r.days", "r.hours", "r.minutes", "r.seconds")


def merged_daily(spark: SparkSession, d: str) -> DataFrame:
    """The roll-up of errors merged with that of all other events: the roll-up of all."""
    e, right, level = table(spark, d, "events"), F.col("event_type") != "error", F.col("event_type")
    parts = [review.daily_with_confidence(e.filter(c), F.to_date("ts"), right, level) for c in (right, ~right)]
    both = review.merge_daily(parts[0], parts[1], "day")
    return both.select(F.col("day").cast("string").alias("day"), "solved", "correct", F.size("confidence").cast("long").alias("levels"))


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return review.sample(table(spark, d, "part").select("p_partkey", "p_name"), 50, 7)


# ---- lines and parts of names ----------------------------------------------------------------------------------
def collapsed_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns whose role differs from that of the turn before."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return clean.collapse_repeats(c, "conv_id", "turn", "role")


def first_pages(spark: SparkSession, d: str) -> DataFrame:
    """Roles as lines of pages: longer ones stay on the first page that has them."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return clean.drop_page_headers(c, "conv_id", "turn", "role")


def joined_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of customers put together of what is there, and whether a pattern taken literally fits."""
    c = table(spark, d, "customer")
    part = F.when(F.col("c_custkey") % 3 == 0, F.lit(None).cast("string")).when(F.col("c_custkey") % 3 == 1, "").otherwise(F.col("c_mktsegment"))
    like = F.concat(F.when(F.col("c_custkey") % 2 == 0, "50%_").otherwise("50ab"), F.col("c_name")).like("%" + X.escape_like("0%_") + "%")
    return c.select("c_custkey", X.join_present(F.col("c_name"), part).alias("name"), X.join_parts(F.col("c_name"), part).alias("parts"), like.cast("int").cast("long").alias("literal"))


def normal_texts(spark: SparkSession, d: str) -> DataFrame:
    """Digests of normalised judgments, and their first word without its ending."""
    clean_text = X.normalize_legal(F.col("text"))
    word = F.regexp_extract(F.col("text"), "[가-힣]{3,14}", 0)
    return judgments(spark, d).select("doc_id", F.sha2(clean_text, 256).alias("digest"), X.strip_ending(word).alias("stem"))


def joined_corpora(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.col("r_name").alias("name"))
    return concat_corpora(n, r).select("name", F.col("source_no").cast("long").alias("source_no"))


# ---- experiments -----------------------------------------------------------------------------------------------
ASKED = ("the of", "house water", "de la", "unknownword nothing")


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    queries = spark.createDataFrame([(q,) for q in ASKED], "query string")
    return experiment.query_frequencies(table(spark, d, "documents"), "doc_id", "text", queries)


def stemmed_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the words of queries whose words, on both sides, are reduced by their endings."""
    queries = spark.createDataFrame([(q,) for q in ASKED], "query string")
    return experiment.by_frequency(experiment.query_frequencies(table(spark, d, "documents"), "doc_id", "text", queries, reduced=True))


def query_frequency(spark: SparkSession, d: str) -> DataFrame:
    return experiment.by_frequency(_frequencies(spark, d))


def query_weight(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return experiment.by_weight(_frequencies(spark, d), docs.count()).withColumn("weight", F.round("weight", 6))


def query_idf(spark: SparkSession, d: str) -> DataFrame:
    return experiment.query_idf(_frequencies(spark, d), table(spark, d, "documents").count()).withColumn("idf", F.round("idf", 6))


def bag_ranks(spark: SparkSession, d: str) -> DataFrame:
    return experiment.bag_distances(table(spark, d, "documents"), "doc_id", "text", "the of and the").select("doc", F.round("cosine", 6).alias("cosine"), F.round("euclid", 6).alias("euclid"), "rank")


def question_postings(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as questions (turn 0) and answers."""
    c = table(spark, d, "conversations")
    posts = c.select(F.when(F.col("turn") == 0, F.col("conv_id")).otherwise(F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") == 0, 1).otherwise(2).alias("kind"), F.when(F.col("turn") > 0, F.col("conv_id")).alias("parent"), "role", "text")
    made = experiment.postings(posts, "id", "kind", "parent", "role", "text")
    return made.select("id", F.sha2("posting", 256).alias("digest"), F.length("posting").cast("long").alias("n"))


def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean vectors of the benchmark's items; each word has the embedding that its md5 chooses among all."""
    b = table(spark, d, "benchmark").select("item_id", "text")
    words = b.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+")).alias("word"))
    made = experiment.pooled_vectors(b, "item_id", "text", word_vectors(spark, d, words))
    return made.select("doc", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


def _jd() -> str:
    n = len(JUDGMENTS)
    return f"j AS (SELECT doc_id, list_extract({texts(JUDGMENTS)}, (doc_id % {n} + 1)::BIGINT) || coalesce(text, '') AS text FROM documents)"


def _frequency_sql() -> str:
    clean = lambda c: f"list_filter(string_split_regex(translate(lower(coalesce({c}, '')), {quoted(experiment.PUNCTUATION)}, ''), '\\s+'), lambda w: w <> '')"
    return f"""q0 AS (SELECT query, unnest({clean("query")}) AS word FROM (SELECT unnest({texts(ASKED)}) AS query)), q AS (SELECT query, word, count(*) AS times FROM q0 GROUP BY ALL),
        d0 AS (SELECT doc_id AS doc, {clean("text")} AS ws FROM documents), d1 AS (SELECT doc, len(ws) AS length, unnest(ws) AS word FROM d0), d2 AS (SELECT doc, length, word, count(*) AS c FROM d1 GROUP BY ALL),
        f AS (SELECT query, doc, length, sum(c * times)::BIGINT AS n FROM d2 JOIN q USING (word) GROUP BY ALL), i AS (SELECT query, count(*) AS df, log2((SELECT count(*) FROM documents) / count(*)) AS idf FROM f GROUP BY query)"""


def _any(column: str, marks) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(m)})" for m in marks) + ")"


def _ends(column: str, marks) -> str:
    return "(" + " OR ".join(f"ends_with({column}, {quoted(m)})" for m in marks) + ")"


def _hangul(then: str, other: str) -> str:
    u = "unicode(right(word, 1))"
    return f"word || CASE WHEN {u} BETWEEN 44032 AND 55203 AND ({u} - 44032) % 28 = 0 THEN {quoted(then)} WHEN {u} BETWEEN 44032 AND 55203 THEN {quoted(other)}"


ENDINGS = "|".join(sorted(set(vocab.ENDINGS), key=len, reverse=True))
STAGE_SQL = texts(review.STAGES)
ALLOWED = ", ".join(quoted(f"{a}>{b}") for a, b in (("", "raw"), *review.TRANSITIONS))
WORDS = f"CASE WHEN doc_id % 7 = 0 THEN source ELSE list_extract({texts(TOPICS)}, (doc_id % {len(TOPICS)} + 1)::BIGINT) END"
LINES = (*HOLDINGS, "영장이 필요한지 여부", "그 범위 (적극)", "10초 분기: 암기", "쟁점이 문제된 사건")
SQL = {
    "section_flags": rf"""WITH {_jd()} SELECT doc_id, contains(text, '판시사항')::BIGINT AS issues, (contains(text, '판결요지') OR contains(text, '결정요지'))::BIGINT AS holding, contains(text, '참조조문')::BIGINT AS statutes,
        contains(text, '참조판례')::BIGINT AS precedents, regexp_matches(text, '(^|\n)\s*【?\s*이\s*유\s*】?\s*($|\n)')::BIGINT AS reasoning, {_any("text", ("다수의견", "반대의견", "보충의견", "별개의견"))}::BIGINT AS opinions FROM j""",
    "case_facts": rf"""WITH {_jd()} SELECT doc_id, replace(regexp_extract(text, '\d{{2,4}}\s*[가-힣]{{1,3}}\s*\d+'), ' ', '') AS number, regexp_extract(text, '{digest.COURTS}') AS court,
        replace(regexp_extract(text, '\d{{4}}\.\s*\d{{1,2}}\.\s*\d{{1,2}}'), ' ', '') AS date FROM j""",
    "verdicts": f"""WITH {rows("v", "pos_, sign, told", [(n, s, t) for n, (s, t) in enumerate(S.VERDICTS)])},
        h AS (SELECT doc_id, list_extract({texts(HOLDINGS)}, (doc_id % {len(HOLDINGS)} + 1)::BIGINT) || coalesce(text, '') AS t FROM documents),
        b AS (SELECT doc_id, arg_min(told, pos_) AS told FROM h JOIN v ON contains(t, sign) GROUP BY doc_id)
        SELECT doc_id, coalesce(told, '') AS verdict FROM h LEFT JOIN b USING (doc_id)""",
    "particles": f"""WITH w AS (SELECT doc_id, {WORDS} AS word FROM documents) SELECT doc_id, {_hangul("를", "을")} ELSE '을' END AS object, {_hangul("는", "은")} ELSE '는' END AS topic FROM w""",
    "text_predicates": rf"""WITH b AS (SELECT item_id, trim(coalesce(text, '') || ' ' || list_extract({texts(LINES)}, (item_id % {len(LINES)} + 1)::BIGINT)) AS t FROM benchmark),
        f AS (SELECT item_id, t, (t = '' OR {_any("t", S.POLARITY_MARKS)} OR {_ends("t", ("여부", "여부.", "는지", "는지."))})::BIGINT AS raw,
          (starts_with(t, '여부') OR contains(t, '/') OR {_ends("t", ("…", "...", "(이하 생략)"))} OR length(t) < 12)::BIGINT AS broken,
          (t = '' OR {_any("t", S.GUIDANCE_MARKS)} OR (length(t) - length(replace(t, ',', '')) >= 4 AND NOT {_any("t", S.PREDICATES)}))::BIGINT AS guidance, {_ends("t", S.TOPIC_ENDINGS)}::BIGINT AS topic FROM b)
        SELECT item_id, raw, broken, guidance, topic, (t = '' OR {_any("t", S.NOTICE_MARKS)} OR guidance = 1 OR broken = 1)::BIGINT AS weak FROM f""",
    "near_equal": r"""WITH p AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^0-9a-zA-Z가-힣\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM conversations),
        x AS (SELECT a.conv_id, a.t AS a, b.t AS b, list_distinct(string_split(a.t, ' ')) AS wa, list_distinct(string_split(b.t, ' ')) AS wb FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
        SELECT conv_id, count(*) FILTER (a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a) OR len(list_intersect(wa, wb)) / greatest(len(wa), len(wb)) >= 0.7)) AS repeated, count(*) AS turns FROM x GROUP BY conv_id""",
    "shrunk_texts": r"""WITH l AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0B\f]'), lambda x: trim(x, E' \t')), lambda x: x <> ''), ' ') AS t FROM documents),
        c AS (SELECT doc_id, t, left(t, 120) AS h FROM l) SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE trim(coalesce(nullif(regexp_extract(h, '(?s)^(.*[.!?])', 1), ''), h)) END AS short FROM c""",
    "review_list": """SELECT p_partkey, p_type FROM part WHERE (p_brand IS DISTINCT FROM 'Brand#11' OR (p_size > 45 AND trim(p_name) <> ''))
        AND trim(coalesce(p_type, '')) <> '' AND (contains(trim(p_type), 'ECONOMY') OR contains('ECONOMY', trim(p_type)))""",
    "shown_cases": "SELECT n_nationkey, coalesce(r_name, n_name) AS n_name FROM nation LEFT JOIN region ON r_regionkey = n_nationkey",
    "found_case": "SELECT c_custkey, c_name, c_custkey::VARCHAR AS id FROM customer WHERE c_name = '7' OR c_custkey::VARCHAR = '7' ORDER BY c_custkey LIMIT 1",
    "renamed_cases": "SELECT s_suppkey, s_suppkey::VARCHAR AS name, (s_suppkey % 2 <> 0 AND s_name IS DISTINCT FROM s_suppkey::VARCHAR)::BIGINT AS migrated FROM supplier",
    "stamped_updates": "SELECT n_nationkey, coalesce(r_name, n_name) AS n_name, CASE WHEN r_regionkey IS NULL THEN '2024-01-01' ELSE '2025-01-01' END AS updated_at FROM nation LEFT JOIN region ON r_regionkey = n_nationkey",
    "stage_log": f"""WITH e AS (SELECT user_id, ts, event_id, list_extract({STAGE_SQL}, (event_id % 4 + 1)::BIGINT) AS stage FROM events),
        s AS (SELECT user_id, coalesce(lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS before, stage AS after FROM e)
        SELECT before, after, count(*) AS n FROM s WHERE before <> after AND before || '>' || after NOT IN ({ALLOWED}) GROUP BY ALL""",
    "daily_confidence": """SELECT (ts::DATE)::VARCHAR AS day, sum(count(*)) OVER (PARTITION BY ts::DATE)::BIGINT AS solved, sum(count(*) FILTER (event_type <> 'error')) OVER (PARTITION BY ts::DATE)::BIGINT AS correct,
        event_type AS level, count(*) AS n FROM events GROUP BY ts::DATE, event_type""",
    "remaining_time": """WITH r AS (SELECT event_id, greatest(0, epoch(TIMESTAMP '2024-02-15 12:34:56')::BIGINT - floor(epoch(ts))::BIGINT) AS s FROM events)
        SELECT event_id, s // 86400 AS days, s % 86400 // 3600 AS hours, s % 3600 // 60 AS minutes, s % 60 AS seconds FROM r""",
    "merged_daily": "SELECT (ts::DATE)::VARCHAR AS day, count(*) AS solved, count(*) FILTER (event_type <> 'error') AS correct, count(DISTINCT event_type) AS levels FROM events GROUP BY ts::DATE",
    "collapsed_turns": r"""WITH x AS (SELECT conv_id, turn, role, lower(regexp_replace(role, '\s', '', 'g')) AS k FROM conversations),
        y AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM x) SELECT conv_id, turn, role FROM y WHERE b IS DISTINCT FROM k""",
    "first_pages": r"""WITH x AS (SELECT conv_id, turn, role, lower(regexp_replace(role, '\s', '', 'g')) AS k FROM conversations),
        y AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, k) AS f FROM x) SELECT conv_id, turn, role FROM y WHERE length(k) < 6 OR turn = f""",
    "joined_names": """WITH p AS (SELECT c_custkey, c_name, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_mktsegment END AS part FROM customer)
        SELECT c_custkey, concat_ws(' ', nullif(c_name, ''), nullif(part, '')) AS name, array_to_string(list_filter([trim(coalesce(c_name, '')), trim(coalesce(part, ''))], lambda x: x <> ''), ' / ') AS parts, (c_custkey % 2 = 0 OR contains(c_name, '0%_'))::BIGINT AS literal FROM p""",
    "normal_texts": f"""WITH {_jd()}, w AS (SELECT doc_id, text, regexp_extract(text, '[가-힣]{{3,14}}') AS w FROM j)
        SELECT doc_id, sha256({NORMAL}) AS digest, CASE WHEN length(w) >= 3 THEN regexp_replace(w, '^(.{{2,}}?)(?:{ENDINGS})$', '\\1') ELSE w END AS stem FROM w""",
    "joined_corpora": "SELECT n_name AS name, 0::BIGINT AS source_no FROM nation UNION ALL SELECT r_name, 1::BIGINT FROM region",
    "device_domains": _domains_sql(),
    "judgment_parts": _judgment_sql(),
    "seeded_sample": "SELECT p_partkey, p_name FROM part ORDER BY md5(concat_ws(':', '7', p_partkey::VARCHAR, p_name)), p_partkey, p_name LIMIT 50",
    "summary_blocks": rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[:\s-]+', ' ', 'g')) || ' 이어서' AS v FROM documents),
        k AS (SELECT doc_id, trim(v) AS v, doc_id % 3 <> 0 AND NOT ({" OR ".join(f"contains(lower(v), {quoted(e)})" for e in review.ECHOES)}) AS good FROM t)
        SELECT doc_id, CASE WHEN good THEN '한 줄 ' || doc_id END AS one_line_summary, CASE WHEN good THEN md5(v) END AS key_issue, CASE WHEN good THEN '판단' END AS ruling_point, CASE WHEN good THEN '암기' END AS exam_takeaway FROM k""",
    "evidence_lines": """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3)
        SELECT o_custkey, string_agg('- ' || o_orderkey || ' ' || o_orderstatus || ' [' || o_orderpriority || ']: 쟁점=' || day || ' / 결론= / 포인트=', chr(10) ORDER BY rank) AS evidence,
          '질문: 비교' || chr(10) || '엔진: rules' || chr(10) || chr(10) || '공통/차이 비교 초안:' || chr(10) || string_agg('- ' || o_orderkey || ' ' || o_orderstatus || ': ' || day, chr(10) ORDER BY rank)
          || chr(10) || chr(10) || '정리: 사건번호별 핵심 쟁점을 기준으로 공통점과 차이점을 확인하세요.' AS draft FROM o GROUP BY o_custkey""",
    "bag_ranks": rf"""WITH d0 AS (SELECT doc_id AS doc, list_filter(string_split_regex(translate(lower(coalesce(text, '')), {quoted(experiment.PUNCTUATION)}, ''), '\s+'), lambda w: w <> '') AS ws FROM documents),
        c AS (SELECT doc, word, count(*) AS c FROM (SELECT doc, unnest(ws) AS word FROM d0) GROUP BY ALL), q AS (SELECT * FROM (VALUES ('the', 2), ('of', 1), ('and', 1)) AS q(word, q)),
        s AS (SELECT doc, coalesce(sum(c * q), 0) AS dot, sum(c * c) AS c2 FROM c LEFT JOIN q USING (word) GROUP BY doc),
        r AS (SELECT doc, round(coalesce(dot / (sqrt(c2) * sqrt(6)), 0), 9) AS cosine, round(sqrt(c2 + 6 - 2 * dot), 9) AS euclid FROM s)
        SELECT doc, round(cosine, 6) AS cosine, round(euclid, 6) AS euclid, row_number() OVER (ORDER BY cosine DESC, doc) AS rank FROM r ORDER BY r.cosine DESC, doc LIMIT 5""",
    "pooled_vectors": r"""WITH w AS (SELECT item_id AS doc, unnest(string_split_regex(coalesce(text, ''), '\s+')) AS word FROM benchmark),
        c AS (SELECT doc, word, count(*) AS n, ('0x' || left(md5(word), 6))::BIGINT % ((SELECT max(vec_id) FROM embeddings) + 1) AS vec_id FROM w WHERE length(word) >= 2 AND NOT regexp_full_match(word, '[\p{Nd}\pP]+') GROUP BY ALL),
        x AS (SELECT doc, n, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS place FROM c JOIN embeddings USING (vec_id) WHERE embedding IS NOT NULL),
        m AS (SELECT doc, place, sum(x * n) / sum(n) AS x FROM x GROUP BY ALL), v AS (SELECT doc, list(x ORDER BY place) AS v, sqrt(sum(x * x)) AS norm FROM m GROUP BY doc)
        SELECT doc, round(list_sum(list_transform(v, lambda a: a / norm)), 6) AS total, round(v[1] / norm, 6) AS first FROM v WHERE norm > 0""",
    "query_frequency": f"WITH {_frequency_sql()}, r AS (SELECT query, doc, n, row_number() OVER (PARTITION BY query ORDER BY n DESC, doc) AS rank FROM f) SELECT * FROM r WHERE rank <= 5",
    "query_weight": f"WITH {_frequency_sql()}, w AS (SELECT query, doc, round(n / length * idf, 9) AS w FROM f JOIN i USING (query)), r AS (SELECT query, doc, w, row_number() OVER (PARTITION BY query ORDER BY w DESC, doc) AS rank FROM w) SELECT query, doc, round(w, 6) AS weight, rank FROM r WHERE rank <= 5 AND w > 0",
    "query_idf": f"WITH {_frequency_sql()} SELECT query, df, round(idf, 6) AS idf FROM i",
    "question_postings": rf"""WITH t AS (SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(translate(lower(coalesce(role, '')), {quoted(experiment.PUNCTUATION)}, ''), '\s+'), lambda w: w <> ''), ' ') AS r,
          array_to_string(list_filter(string_split_regex(translate(lower(coalesce(text, '')), {quoted(experiment.PUNCTUATION)}, ''), '\s+'), lambda w: w <> ''), ' ') AS t FROM conversations),
        a AS (SELECT conv_id, string_agg(t, ' ' ORDER BY conv_id * 1000 + turn) AS answers FROM t WHERE turn > 0 GROUP BY conv_id),
        p AS (SELECT conv_id AS id, r || ' ' || t || ' ' || answers AS posting FROM t JOIN a USING (conv_id) WHERE turn = 0)
        SELECT id, sha256(posting) AS digest, length(posting)::BIGINT AS n FROM p""",
}
QUERIES = {
    f.__name__: f
    for f in (
        judgment_parts, device_keyphrases, device_sentences, device_domains, device_extraction, sentence_roles, case_digests, section_flags, case_facts, scan_keywords, verdicts, particles, text_predicates,
        near_equal, shrunk_texts, issue_statements, card_texts, truth_items, evidence_lines, scanned_rows, summary_blocks, review_list, shown_cases, found_case, renamed_cases, stamped_updates,
        stage_log, daily_confidence, remaining_time, merged_daily, seeded_sample, collapsed_turns, first_pages, joined_names, normal_texts, joined_corpora, query_frequency, query_weight, query_idf, stemmed_ranks, bag_ranks, question_postings, pooled_vectors,
    )
}
