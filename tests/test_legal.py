"""Statements, digests, quiz chains, reviews and experiments on small cases."""

import math
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import statements as S
from quillspark.operators import device, digest, experiment, quiz, review


def one(spark, make, *values):
    """The value of an expression over the given strings."""
    df = spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"v{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("issue", "polarity", "want"),
    [
        ("영장이 필요한지 여부(적극)", "positive", "영장이 필요하다."),
        ("증거능력이 인정되는지 여부(소극)", "negative", "증거능력이 인정되지 않는다."),
        ("위 증인이 될 수 있는지 여부(한정 적극)", "limited_positive", "일정한 경우 위 증인이 될 수 있다."),
        ("그 범위", "unknown", "그 범위."),
        ("정한 바를 어기는지", "negative", "정한 바를 어기지 않는다."),
        ("'송금메모'가 이에 해당하는지 여부", "positive", "'송금메모'가 '송금메모'에 해당한다."),
        ("여부(적극)", "positive", ""),
        (None, "positive", ""),
    ],
)
def test_declarative(spark, issue, polarity, want):
    got = one(spark, S.declarative, issue, polarity)
    assert got == want.replace("일정한 경우 위 ", "일정한 경우 ")


def test_pronouns_only_after_their_noun(spark):
    assert one(spark, S.resolve_pronouns, "이에 '매체'가 해당한다") == "이에 '매체'가 해당한다"
    assert one(spark, S.resolve_pronouns, "'매체'의 뜻과 이를 정한 법") == "'매체'의 뜻과 '매체'를 정한 법"


def test_particles_follow_the_last_syllable(spark):
    for word in ("손해", "영장", "abc", "", "책"):
        final = [] if not word or not "가" <= word[-1] <= "힣" else [(ord(word[-1]) - 0xAC00) % 28 != 0]
        assert one(spark, S.object_particle, word) == ("를" if final == [False] else "을")
        assert one(spark, lambda c: S.particle(c, "은", "는"), word) == ("은" if final == [True] else "는")


def test_repair_and_scrub(spark):
    assert one(spark, S.repair_spacing, "구성 요\n건에 관 한 위법 수집증거를 담보하 는 것") == "구성요건에 관한 위법수집증거를 담보하는 것"
    assert one(spark, S.scrub, "[공2026상,1] 〈판단〉 한 다  [공보 끝") == "판단 한다"


def test_near_equal(spark):
    assert one(spark, S.near_equal, "a b c d e f g", "a b c d e f x") and one(spark, S.near_equal, "A, b!", "a b c")
    assert not one(spark, S.near_equal, "a b c", "d e f") and not one(spark, S.near_equal, "", "")


def test_shortening(spark):
    assert one(spark, lambda c: S.shrink(c, 10), "가나다. 라마바사아자차") == "가나다."
    assert one(spark, lambda c: S.shrink(c, 5), "가나다라마바") == "가나다라마"
    text = "판단한다. " * 4 + "더 긴 말이 이어지는 문장"
    assert one(spark, lambda c: S.card_truncate(c, 30, ("다.", "요.")), text) == "판단한다. 판단한다. 판단한다. 판단한다."
    assert one(spark, lambda c: S.card_truncate(c, 30, ("다.", "요.")), "가" * 50) == "가" * 30 + S.CUT_MARK
    assert one(spark, S.card_terminal, "끝") == "끝." and one(spark, S.card_terminal, "") == ""


def test_statements_for_questions(spark):
    assert one(spark, S.sanitize_statement, "[모해위증] 영장이 필요한지 여부(소극)") == "영장이 필요하지 않다."
    assert one(spark, S.single_statement, "피고인은 유죄로 인정된다. 그러나 형은 다르다") == "피고인은 유죄로 인정된다."
    assert one(spark, S.negate_statement, "그 행위는 범죄에 해당한다.", "x") == "그 행위는 범죄에 해당하지 않는다."
    assert one(spark, S.negate_statement, "그렇다.", "2020도1").startswith("위 판례의 실제 결론은")
    assert one(spark, S.negate_statement, "그렇다.", "강도").startswith("『강도』")
    assert not one(spark, S.useful_statement, "제1조 제2조 제3조 제4조를 적용한다.") and one(spark, S.useful_statement, "영장 없이 압수할 수 없다.")


def test_issue_core_and_topic(spark):
    assert one(spark, S.issue_core, "는 손해의 범위에 관한 기준이 문제 된 사건") == "손해의 범위에 관한 기준이 문제 된"
    assert one(spark, S.compact_topic, "음란죄에서 '통신매체'와 '송금메모'와 '전화'") == "음란죄 / 통신매체 / 송금메모"
    assert one(spark, S.first_sentence, "근거:\n- 사건: x\n- 결론: 유죄이다") == "유죄이다"


def test_cut_sentences():
    assert digest.cut_sentences('그는 "그만. 가자." 하고 말했다. 그리고 떠났다') == ['그는 "그만. 가자." 하고 말했다.', "그리고 떠났다"]
    assert digest.cut_sentences("") == [] and digest.cut_sentences("1. 가. 나다라마바사아.") == ["1. 가. 나다라마바사아."]


def test_conclusion(spark):
    make = lambda c: digest.conclusion(c, F.split(c, r"(?<=\.) "))
    assert one(spark, make, "피고인이 증언하였다. 원심은 위법하다. 그 밖의 사정") == "원심은 위법하다."
    assert one(spark, make, "사정이 있음") == "사정이 있음"


def test_facts(spark):
    text = "대법원 2020. 5. 14. 선고 2019 도 12345 판결\n주 문\n\n상고를 기각한다.\n비용 부담.\n셋째 줄\n이 유\n"
    assert one(spark, digest.case_number, text) == "2019도12345" and one(spark, digest.decided_on, text) == "2020.5.14"
    assert one(spark, digest.disposition, text) == "상고를 기각한다. 비용 부담." and one(spark, digest.disposition, "x") is None
    assert one(spark, digest.subject, "[다수의견] [모해위증] x") == "모해위증" and one(spark, digest.subject, "아무것도") == ""
    assert one(spark, digest.subject, "〈담보공탁금이 손해를 담보하는지가 문제 된 사건〉") == "담보공탁금"


def test_digest_domain_differs_from_the_device(spark):
    acts, text = F.array().cast("array<string>"), "형사소송법과 형법을 함께"
    assert one(spark, device.domain_of_laws, text) == "criminal_law"
    assert one(spark, lambda c: digest.digest_domain(acts, c), text) == "criminal_procedure_evidence"
    assert one(spark, lambda c: digest.digest_domain(acts, c), "형사소송법과 형법 제1조") == "criminal_law"


def test_device_keyphrases_and_sentences(spark):
    text = "제1조와 제2조와 제3조. 영장 없이 압수수색한 증거의 증거능력. 절도 절도 절도와 점유의 침해는 처벌한다."
    got = one(spark, lambda c: device.keyphrases(c, 8), text)
    assert got[:2] == ["제1조", "제2조"] and got[2:4] == ["영장", "압수수색"] and "제3조" in got + ["제3조"] and len(got) == len(set(got)) <= 8
    parts = one(spark, device.sentences, "첫 문장은 여기에서 끝난다.\n는 손해의 범위에 관하여 판단한다.\n짧다")
    assert parts == ["첫 문장은 여기에서 끝난다 는 손해의 범위에 관하여 판단한다"]


def test_scan_keywords_drop_times(spark):
    got = one(spark, digest.scan_keywords, "08경 경부터 5월 영장을 영장의 제3조 처분")
    assert got[:1] == ["제3조"] and "영장" in got and not {"08경", "경부터", "5월"} & set(got)


def test_truth_items_and_fill(spark):
    df = spark.createDataFrame([(["영장 없이 압수한 것은 위법하다.", "그 증거는 증거능력이 인정된다."], "2020도1", "강도")], "s array<string>, n string, c string")
    none = F.array().cast("array<string>")
    items = df.select(quiz.truth_items(F.col("s"), none, F.col("n"), F.col("c"), 3).alias("x")).first()["x"]
    assert [i["answer"] for i in items] == [True, False, True] and items[1]["statement"] == "그 증거는 증거능력이 인정되지 않는다."
    fallback = quiz.truth_items(F.col("s"), none, F.col("n"), F.col("c"), 3)
    made = F.array(*[F.struct(F.lit(t).alias("statement"), F.lit(True).alias("answer"), F.lit("").alias("explanation")) for t in ("영장 없이 압수한 것은 위법하다.", "새로운 진술은 허용된다고 본다.", "…")])
    got = [i["statement"] for i in df.select(quiz.accepted_items(made, fallback, 3).alias("x")).first()["x"]]
    assert got == ["영장 없이 압수한 것은 위법하다.", "새로운 진술은 허용된다고 본다.", "그 증거는 증거능력이 인정되지 않는다."]
    assert df.select(quiz.truth_items(none, none, F.col("n"), F.col("c"), 3).alias("x")).first()["x"] == []


def test_hints_and_evidence(spark):
    empty = F.array().cast("array<string>")
    hints = one(spark, lambda c: quiz.decision_hints(c, empty, F.array(F.lit("자백"), F.lit("임의성"), F.lit("영장")), F.lit(1)), "일반 문장")
    assert len(hints) == 3 and hints[0] == quiz.HINTS["general"][0] and hints[1] in quiz.TRAPS["general"] and "자백, 임의성 —" in hints[2]
    assert hints == one(spark, lambda c: quiz.decision_hints(c, empty, F.array(F.lit("자백"), F.lit("임의성"), F.lit("영장")), F.lit(1)), "일반 문장")
    got = one(spark, lambda i, h: quiz.merged_evidence(i, h, F.lit(S.NO_EXAM), F.lit(""), empty, F.lit("형법 · 절도"), F.array(F.lit("형법"))), "그 행위는 절도에 해당한다고 본다.", S.NO_RULING)
    assert (got["issue"], got["holding"], got["exam"]) == ("그 행위는 절도에 해당한다고 본다.",) * 2 + ("핵심 키워드: 형법, 절도",)


def test_blocks():
    good = "- 요약: 한 줄\n- key_issue: 쟁점이\n이어진다\n결론: 기각\n시험 포인트: 암기"
    assert review.parse_block(good) == {"one_line_summary": "한 줄", "key_issue": "쟁점이 이어진다", "ruling_point": "기각", "exam_takeaway": "암기"}
    assert review.parse_block(good.replace("기각", "key_issue")) is None and review.parse_block("요약: 하나") is None and review.parse_block(None) is None


def test_updates_and_samples(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "old")], "k int, v string, at string")
    got = review.update_rows(rows, spark.createDataFrame([(2, None)], "k int, v string"), "k", "at", F.lit("now"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", None), (2, None, "now")]
    wide = spark.range(1000)
    draw = lambda df, seed: sorted(r.id for r in review.sample(df, 20, seed).collect())
    assert draw(wide, 1) == draw(wide.repartition(7), 1) != draw(wide, 2) and len(draw(wide, 1)) == 20


def test_query_frequencies_against_loops(spark):
    docs = {1: "The cat, the dog.", 2: "a dog's life", 3: "", 4: None, 5: "cat cat cat"}
    df = spark.createDataFrame(list(docs.items()), "d long, t string")
    queries = ["the cat", "dog dog", "none"]
    words = lambda t: [w for w in re.sub("[^a-z\\s]", "", (t or "").lower()).split()]
    got = {(r.query, r.doc): (r.n, r.length, r.by_word) for r in experiment.query_frequencies(df, "d", "t", spark.createDataFrame([(q,) for q in queries], "query string")).collect()}
    want = {(q, d): (sum(words(t).count(w) for w in words(q)), len(words(t)), {w: words(t).count(w) for w in words(q) if w in words(t)}) for q in queries for d, t in docs.items() if set(words(q)) & set(words(t))}
    assert got == want
    freq = experiment.query_frequencies(df, "d", "t", spark.createDataFrame([(q,) for q in queries], "query string"))
    idf = {r["query"]: (r["df"], r["idf"]) for r in experiment.query_idf(freq, 5).collect()}
    assert idf == {"the cat": (2, math.log2(5 / 2)), "dog dog": (1, math.log2(5))}


def test_bag_distances_and_pooled_vectors(spark):
    df = spark.createDataFrame([(1, "aa bb bb"), (2, "cc"), (3, "1. x")], "d long, t string")
    got = {r.doc: (round(r.cosine, 6), round(r.euclid, 6)) for r in experiment.bag_distances(df, "d", "t", "bb aa").collect()}
    assert got[1] == (round(3 / math.sqrt(10), 6), 1.0) and got[2] == (0.0, round(math.sqrt(3), 6))
    vectors = spark.createDataFrame([("aa", [1.0, 0.0]), ("bb", [0.0, 1.0]), ("x", [9.0, 9.0])], "word string, vector array<double>")
    made = {r.doc: r.vector for r in experiment.pooled_vectors(df, "d", "t", vectors).collect()}
    assert set(made) == {1} and made[1] == pytest.approx([1 / math.sqrt(5), 2 / math.sqrt(5)])


def test_stages(spark):
    log = spark.createDataFrame([("a", "raw", 1), ("a", "normalized", 2), ("a", "reviewed", 3), ("b", "normalized", 1), ("c", "raw", 1), ("c", "reviewed", 2), ("c", "reviewed", 3)], "i string, s string, t int")
    assert sorted(map(tuple, review.stage_violations(log, "i", "s", "t").collect())) == [("b", "", "normalized"), ("c", "raw", "reviewed")]


def test_scanned_rows(spark):
    rec = spark.createDataFrame([(1, None, "피고인", "사 건\n2024도4422 강도치상\n" + "x" * 2000, ["a", "b", "c", "d"], None, "핵심", "결론", None)], "id long, case_number string, case_name string, raw_text string, keywords array<string>, key_issue string, key_sentences string, ruling_point string, exam_takeaway string")
    r = digest.case_rows(rec).first()
    assert (r.case_number, r.case_name, r.subject, r.search_subject, r.issue_summary, r.exam_points) == ("2024도4422", "강도치상", "a · b · c", "a · b · c · d", "핵심", "a, b, c, d")
    assert len(r.search_summary) == len("핵심 ") + 1500
