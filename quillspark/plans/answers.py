"""Composed reads: retrieval of evidence, grounded answers, one-document extraction."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.params import clamped
from ..functions.rounding import round_exact
from ..operators import classify, grams, grounding, quiz
from ..operators.relational import any_contains, relevance
from ..operators.textrank import best_sentences
from ..sources.files import write_lines

# --- fixed values: texts of answers ------------------------------------------------------------
NO_EVIDENCE = "근거 데이터가 부족하여 단정하기 어렵습니다. 사건번호 또는 핵심 쟁점 키워드로 다시 검색해 주세요."
SUMMARIES = ("issue_summary", "holding_summary", "exam_points")
# --- fixed values: templates of answers ---------------------------------------------------------
PLAIN = "근거 기반 요약(강의 대체 아님):\n- 사건: [{number}] {name}\n- 쟁점: {issue}\n- 결론: {holding}\n- 복습: 헷갈리는 포인트는 유사판례 비교 또는 OX 반복으로 확인한다."
COMPARE = "비교 요약(강의 대체 아님):\n- 공통점: {subject} 범위에서 쟁점 판단 구조가 유사하다.\n- 차이점: [{number}] {holding} / [{number2}] {holding2}\n- 복습 포인트: 결론만 외우지 말고 쟁점-근거-결론 순서로 암기한다."
DRILL = "훈련용 체크포인트:\n- [{number}]에서 핵심 쟁점을 한 문장으로 정리한다.\n- 유사 판례와 결론이 달라지는 요건을 한 가지 찾는다.\n- 결론 문장의 한 글자만 바꾸어 OX 함정 지문을 만든다."
BOTH = "[{number}] {name} 사건은 {issue_end} 쟁점에 대해 {holding_end} 라고 판단한 판례이다."
ONLY = "[{number}] {name} 사건은 {holding_end} 라고 판단한 판례이다."
NEITHER = "[{number}] {name} 판례 — 근거 문장이 부족하여 한 줄 요약이 어렵다."


def question_parts(spark: SparkSession, question: str) -> tuple[str, list[str]]:
    """The normalised question and its keyphrases (one row of one job)."""
    clean = spark.createDataFrame([(question,)], "text string").select(X.normalize_legal(F.col("text")).alias("clean"))
    row = clean.select("clean", classify.phrases(F.col("clean"), 6).alias("phrases")).first()
    return row["clean"], row["phrases"]


def retrieve(cases: DataFrame, question: str, top_k: int, index: grams.Grams | None = None) -> DataFrame:
    """Published cases that contain the question, or the first of its keyphrases with a digit
    as case number, by weighted relevance and then the newest. Keyphrases add to the score
    of what is found, they don't find more. With an index of the cases' fields by case number only
    the cases that it gives are looked at."""
    clean, phrases = question_parts(cases.sparkSession, question)
    if len(clean) < 2:
        return cases.limit(0).withColumn("relevance", F.lit(0))
    number = next((p for p in phrases if any(c.isdigit() for c in p)), None)
    c, q = F.col, clean[:80]
    by_number = X.contains_any_case(c("case_number"), number) if number else F.lit(False)
    tests = [(by_number, 8), (X.contains_any_case(c("case_name"), q), 4)]
    tests += [(X.contains_any_case(c(s), q), w) for s, w in zip(SUMMARIES, (3, 3, 2), strict=True)]
    tests += [(any_contains([c(s) for s in SUMMARIES], p), w) for p, w in zip(phrases[:3], (2, 1, 1), strict=False)]
    hit = any_contains([c("case_name"), *[c(s) for s in SUMMARIES]], q) | by_number
    if index is not None:
        found = grams.containing(index, q, ["case_name", *SUMMARIES]).select("doc")
        found = found.unionByName(grams.containing(index, number, ["case_number"]).select("doc")) if number else found
        cases = cases.join(found.distinct().withColumnRenamed("doc", "case_number"), "case_number", "left_semi")
    scored = cases.filter(hit).withColumn("relevance", relevance(tests))
    return scored.orderBy(F.desc("relevance"), F.desc("updated_at"), "case_number").limit(clamped(top_k, 1, 10))


def _template(pattern: str, **parts: Column) -> Column:
    out = F.lit(pattern)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def answer(cases: DataFrame, question: str, intent: str, top_k: int = 3, index: grams.Grams | None = None) -> DataFrame:
    """One row: answer, citations, domain and the names of the rules that it breaks."""
    if len(question.strip()) < 2:
        raise ValueError("the question needs two characters at least")
    return told(retrieve(cases, question, top_k, index), question, intent, top_k)


def told(found: DataFrame, question: str, intent: str, top_k: int = 3) -> DataFrame:
    """The answer from the cases that were retrieved; several intents of one question can share these."""
    order = Window.orderBy(F.desc("relevance"), F.desc("updated_at"), "case_number")
    snippet = X.snippet(*[F.col(s) for s in SUMMARIES])
    rows = found.withColumns({"rank": F.row_number().over(order), "snippet": snippet})  # ten rows at most
    fields = ("rank", "case_number", "case_name", "subject", *SUMMARIES, "snippet")
    one = rows.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("r"))
    r = F.col("r")
    at = lambda i, name: F.coalesce(F.get(r, F.lit(i))[name], F.lit(""))
    short = lambda i, name, n: X.smart_truncate(at(i, name), n)
    one = one.withColumns(
        {
            "issue": short(0, "issue_summary", 70 if intent == "summary" else 90),
            "holding": short(0, "holding_summary", 90 if intent not in ("summary", "compare") else 70),
            "holding2": short(1, "holding_summary", 70),
        }
    )
    names = {"number": at(0, "case_number"), "name": at(0, "case_name"), "subject": at(0, "subject"), "number2": at(1, "case_number")}
    texts = {"issue": F.col("issue"), "holding": F.col("holding"), "holding2": F.col("holding2"), "issue_end": X.ensure_terminal(F.col("issue")), "holding_end": X.ensure_terminal(F.col("holding"))}
    fill = lambda pattern: _template(pattern, **names, **texts)
    if intent == "summary":
        said = F.when((F.col("issue") != "") & (F.col("holding") != ""), fill(BOTH)).when(F.col("holding") != "", fill(ONLY)).otherwise(fill(NEITHER))
    elif intent == "quiz":
        said = fill(DRILL)
    elif intent == "compare":
        said = F.when(F.size(r) >= 2, fill(COMPARE)).otherwise(fill(PLAIN))
    else:
        said = fill(PLAIN)
    cited = F.slice(r, 1, clamped(top_k, 1, 4))
    merged = F.array_join(F.transform(F.slice(r, 1, 3), lambda x: F.concat_ws(" ", *[F.coalesce(x[n], F.lit("")) for n in fields[1:-1]])), "\n")
    some = F.size(r) > 0
    out = one.withColumn("answer", F.when(some, said).otherwise(F.lit(NO_EVIDENCE)))
    flags = grounding.violations(F.col("answer"), F.transform(cited, lambda x: x["case_number"]), F.transform(r, lambda x: x["case_number"]), F.transform(cited, lambda x: x["snippet"]), F.transform(r, lambda x: x["snippet"]))
    return out.select(
        F.lit(question).alias("question"),
        "answer",
        F.transform(cited, lambda x: F.struct(x["case_number"].alias("case_number"), x["case_name"].alias("case_name"), x["snippet"].alias("quoted_text"))).alias("citations"),
        F.when(some, flags).otherwise(F.array(F.lit("insufficient_evidence"))).alias("safety_flags"),
        F.when(some, classify.study_domain(merged, F.transform(r, lambda x: F.coalesce(x["subject"], F.lit(""))))).otherwise(F.lit("general_legal")).alias("domain"),
    )


def extract(docs: DataFrame, doc: str, text: str, phrases: int = 10, sentences: int = 5) -> DataFrame:
    """Keyphrases, key sentences, domain and study focus of each document: all of them functions of its
    text, in one pass and without a shuffle."""
    clean = docs.select(F.col(doc).alias("doc"), F.col(text).alias("__text"), X.normalize_legal(F.col(text)).alias("clean"))
    made = clean.select("doc", "__text", classify.phrases(F.col("clean"), phrases).alias("phrases"), best_sentences(F.col("clean"), sentences).alias("sentences"))
    named = made.withColumn("domain", classify.study_domain(F.col("__text"), F.col("phrases")))
    return named.select("doc", "phrases", "sentences", "domain", classify.study_focus(F.col("domain"), F.col("phrases"), F.col("sentences")).alias("focus"))


def evaluated(docs: DataFrame, doc: str, text: str, keywords: int = 10, sentences: int = 5) -> DataFrame:
    """One row for each sample: id, keywords, key_sentences, the legal signals of the normalised text and of
    its key sentences by pattern, and the share that is retained (0 without signals), to four digits."""
    clean = docs.select(F.col(doc).cast("string").alias("id"), X.normalize_legal(F.col(text)).alias("clean"))
    made = clean.select("id", "clean", classify.phrases(F.col("clean"), keywords).alias("keywords"), best_sentences(F.col("clean"), sentences).alias("key_sentences"))
    rows = made.select("id", "keywords", "key_sentences", X.legal_signals(F.col("clean")).alias("original_signals"), X.legal_signals(F.col("key_sentences")).alias("summary_signals"))
    total = lambda c: sum((F.col(f"{c}.{s}") for s in X.SIGNALS), F.lit(0)).cast("double")
    share = F.coalesce(F.try_divide(total("summary_signals"), total("original_signals")), F.lit(0.0))
    return rows.withColumn("signal_retention", round_exact(share, 4))


def evaluation(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the samples as JSON lines, if a path is given, and sums them up in the same pass: their number
    and the means of retention (four digits), of the number of keywords and of the length of the key sentences (two). One row; zeros
    without samples."""
    seen = Observation()
    exact = F.sum(F.col("signal_retention").cast("decimal(38,4)"))  # rounded values: their sum doesn't depend on the order
    watched = rows.observe(seen, F.count("*").alias("n"), exact.alias("retention"), F.sum(F.size("keywords")).alias("keywords"), F.sum(F.length("key_sentences")).alias("length"))
    if path is None:
        watched.write.format("noop").mode("overwrite").save()
    else:
        write_lines(watched, path)
    n = seen.get["n"]
    mean = lambda name, digits: round(float(Fraction(seen.get[name] or 0) / n), digits) if n else 0.0
    row = (n, mean("retention", 4), mean("keywords", 2), mean("length", 2))
    return rows.sparkSession.createDataFrame([row], "samples long, avg_signal_retention double, avg_keyword_count double, avg_key_sentence_length double")


def summarize(docs: DataFrame, doc: str, name: Column, sentences: str, keywords: str, count: int = 3) -> DataFrame:
    """One-line summary, issue, ruling and quiz items of each document, by rules."""
    lines, k = F.col("__lines"), F.coalesce(F.col(keywords), F.array().cast("array<string>"))
    some = F.size(k) > 0
    return docs.withColumn("__lines", quiz.key_lines(F.col(sentences))).select(
        F.col(doc).alias("doc"),
        F.when(some, F.concat(name, F.lit(" 판례는 "), F.array_join(F.slice(k, 1, 3), ", "), F.lit(" 등을 핵심 쟁점으로 다룬 판례이다.")))
        .otherwise(F.concat(name, F.lit(" 판례의 핵심 쟁점은 제공된 문장에서 직접 확인이 필요하다.")))
        .alias("one_line_summary"),
        F.coalesce(F.get(k, F.lit(0)), F.lit("핵심 쟁점 확인 필요")).alias("key_issue"),
        F.coalesce(F.get(lines, F.lit(0)), F.lit("핵심 문장 정보가 부족합니다.")).alias("ruling_point"),
        F.concat(F.lit("시험 포인트: "), F.array_join(F.slice(k, 1, 5), ", ")).alias("exam_takeaway"),
        quiz.quiz_items(lines, k, count).alias("quiz"),
        F.transform(F.slice(lines, 1, 3), lambda s: X.smart_truncate(s, 180)).alias("citations"),
    )
