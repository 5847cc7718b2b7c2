import datetime as dt
import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import queries
from quillspark.functions import text as X
from quillspark.functions import vocab
from quillspark.operators import classify, clean, grounding, relational, study, textrank
from quillspark.sources import files
from quillspark.sources.html import text_of
from quillspark.streaming.daily import daily_stream

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_as_sql(spark, tables, name):
    df = queries.queries()[name](spark, DATA)
    q = tables.execute(queries.oracle_sql()[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in q.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "stem"),
    [("법원은", "법원"), ("은", "은"), ("나는", "나는"), ("법원에서는", "법원"), ("피고인으로서", "피고인"), ("위법하였다", "위법"), ("사과", "사과")],
)
def test_strip_ending(spark, word, stem):
    assert one(spark, X.strip_ending(F.col("w")), w=word) == stem


def test_normalize(spark):
    got = one(spark, X.normalize_legal(F.col("t")), t="가 https://a.b/c 나\t\t다 [ 이유 ]라\n\n\n마  바 www.x.y ")
    assert got == "가 나 다 \n[이유]\n라\n마 바"


def test_truncate_and_terminal(spark):
    text = "피고인은 유죄이다. 원심은 정당하다. 나머지 주장은 이유 없어 받아들이지 않는다"
    assert one(spark, X.smart_truncate(F.col("t"), 24), t=text) == "피고인은 유죄이다. 원심은 정당하다."
    assert one(spark, X.smart_truncate(F.col("t"), 100), t=text) == text
    assert one(spark, X.smart_truncate(F.col("t"), 30), t="aaaa bbbb cccc dddd eeee ffff gggg") == "aaaa bbbb cccc dddd eeee ffff…"
    assert one(spark, X.ensure_terminal(F.col("t")), t="판단하였다") == "판단하였다"
    assert one(spark, X.ensure_terminal(F.col("t")), t="판단") == "판단…"
    assert one(spark, X.snippet(F.col("a"), F.col("b")), a=" 쟁점 ", b=None) == "쟁점"
    assert one(spark, X.snippet(F.col("a")), a="  ") == vocab.NO_SUMMARY


def test_escape_like(spark):
    assert X.escape_like("50%_\\") == "50\\%\\_\\\\"


def test_keyphrases(spark):
    text = "대법원 2012도1234 판결은 형법 제 20 조를 적용하였다. 위법성은 위법성이 조각된다. 사과가 사과를"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "사과를 먹는 사과는")], "id long, text string")
    got = {r.doc: r.phrases for r in classify.keyphrases(docs, "id", "text", 5).collect()}
    assert got[1] == ["제20조", "2012도1234", "대법원", "위법성", "적용"]
    assert got[2] == [] and got[3][0] == "사과"
    assert classify.keyphrases(docs, "id", "text", 2).filter("doc = 1").first()["phrases"] == ["제20조", "2012도1234"]


@pytest.mark.parametrize(
    ("text", "domain"),
    [("헌법만 있다", "general_legal"), ("헌법 위헌", "constitutional_law"), ("영장 증거 위헌 헌법", "constitutional_law"), ("영장 없는 압수와 증거", "criminal_procedure_evidence"), (None, "general_legal")],
)
def test_domain(spark, text, domain):
    assert one(spark, classify.study_domain(F.col("t")), t=text) == domain


def test_focus_and_weights(spark):
    lines = one(spark, classify.study_focus(F.lit("criminal_law"), F.array(F.lit("a"), F.lit("b")), F.col("t")), t="첫 줄\n둘째")
    assert len(lines) == 3 and lines[2].endswith("a, b")
    got = one(spark, classify.weighted_class(F.col("t"), {"x": {"가": 2.0, "나": 1.0}, "y": {"나": 2.5}}), t="가 나")
    assert (got.name, round(got.confidence, 4), got.runner_up) == ("x", round(3 / 5.6, 4), "y")


def test_clean_lines(spark):
    text = "제목 줄입니다\n12:30\n- 3 -\n제목  줄입니다\n짧다\n짧다\nhttps://x.y\n끝입니다\n끝"
    docs = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    assert {r.id: r.text for r in clean.clean_lines(docs, "id", "text").collect()} == {1: "제목 줄입니다\n짧다\n짧다\n끝입니다", 2: ""}


def test_grounding(spark):
    def flags(answer, cited, quotes):
        arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        return one(spark, grounding.violations(F.col("a"), arr(cited), arr(["1", "2"]), arr(quotes), arr(["the quick brown fox"])), a=answer)

    assert flags("fine", ["1"], ["quick brown"]) == []
    assert flags("fine", [], []) == ["must_have_citation"]
    assert flags("fine", ["1", "3"], []) == ["citation_must_exist_in_retrieval"]
    assert flags("Unknown", ["1"], []) == ["uncertainty_on_missing_evidence"]
    assert flags("unknown, insufficient", ["1"], ["quick b"]) == ["quote_must_match_snippet"]  # 7 characters
    assert flags("fine", ["2"], ["xxquick brxx"]) == []  # exactly 8 in common


def test_textrank():
    sets = [{"a", "b", "c"}, {"a", "b", "d"}, {"x", "y"}, {"a", "c", "d"}]
    n = len(sets)
    m = np.array([[0 if i == j else len(a & b) / len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    s = np.ones(n) / n
    for _ in range(30):
        t = 0.15 / n + 0.85 * m.T @ s
        if np.allclose(s, t, atol=1e-6):
            break
        s = t
    assert np.allclose(textrank.ranks(sets), s)
    assert np.allclose(textrank.ranks([{"a"}, {"b"}]), textrank.ranks([set(), set()]))


def test_key_sentences(spark):
    text = "첫째 문장은 아주 평범한 내용이다.\n둘째 문장은 대법원 2012도1234 판결과 위법성을 다룬다.\n셋째 문장도 역시 평범한 내용이다."
    docs = spark.createDataFrame([(1, text), (2, "짧다"), (3, None)], "id long, text string")
    got = {r.doc: r.sentences for r in textrank.key_sentences(docs, "id", "text", 1).collect()}
    assert got[1].startswith("둘째") and got[2] == "" and got[3] == ""
    assert textrank.key_sentences(docs, "id", "text", 5).filter("doc = 1").first()["sentences"].count("\n") == 2


def test_streaks(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("a", day(8)), ("a", day(9)), ("a", day(10)), ("b", day(8)), ("b", day(9)), ("c", day(1)), ("c", day(10)), ("d", day(5))]
    got = study.streaks(spark.createDataFrame(rows, "u string, day date"), "u", "day", F.to_date(F.lit("2024-01-10")))
    assert {r.u: r.streak for r in got.collect()} == {"a": 3, "b": 2, "c": 1}


def test_weak_subjects(spark):
    rows = [("x > y > 1", "O"), ("x > y > 2", "X"), ("x > z", "X"), (" ", "X"), ("q", "X"), ("q", "X")]
    answers = spark.createDataFrame(rows, "path string, answer string")
    assert [(r[0], r[1]) for r in study.weak_subjects(answers, F.col("path"), 5).collect()] == [("q", 2), ("x > y", 2)]
    assert [(r[0], r[1]) for r in study.weak_subjects(answers, F.col("path"), 5, wrong=F.col("answer") == "X").collect()] == [("q", 2)]


def test_search_is_join_and_dedup(spark):
    rows = spark.createDataFrame([(1, "Alpha"), (2, "beta"), (3, None)], "id long, name string")
    words = spark.createDataFrame([(2, "alphabet"), (2, "ALPHA"), (3, "other")], "id long, word string")
    assert sorted(r.id for r in relational.search(rows, words.withColumnRenamed("id", "id"), "id", ["name"], "word", "alpha").collect()) == [1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"x","text":"가"}\n\n{"text":"b"}\n', encoding="utf-8")
    assert sorted(tuple(r) for r in files.read_samples(spark, str(tmp_path / "a.jsonl")).collect()) == [("row-3", "b"), ("x", "가")]
    (tmp_path / "b.jsonl").write_text('{"id":"x"}\n')
    with pytest.raises(Exception, match="line 1"):
        files.read_samples(spark, str(tmp_path / "b.jsonl")).collect()
    (tmp_path / "p.xml").write_text('<posts><row Id="1" PostTypeId="1" Title="t" Body="&lt;p&gt;x&lt;/p&gt;"/></posts>')
    post = files.read_posts(spark, str(tmp_path / "p.xml")).first()
    assert (post.Id, post.Title, text_of(post.Body)) == (1, "t", "x")
    assert text_of("<p>a<script>var x</script>&amp;b</p>") == "a&b" and text_of(None) == ""


def test_daily_stream_as_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{DATA}/events*.parquet")
    q = daily_stream(stream).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = study.daily_rollup(events, F.to_date("ts"), F.col("event_type") != "error", "user_id")
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted((r.user_id, r.day, r.solved, r.correct) for r in want.collect())


def test_issue_graph(spark):
    from quillspark.operators import issues

    direct = one(spark, issues.direct_issues(F.col("t")), t="자백과 영장 없는 압수수색")
    assert direct == ["영장", "압수수색", "자백"]
    related = one(spark, issues.related_issues(issues.direct_issues(F.col("t"))), t="자백과 영장 없는 압수수색")
    assert related == ["체포", "사후영장", "증거능력", "위법수집증거", "보강증거", "임의성"]
    assert one(spark, issues.category(issues.direct_issues(F.col("t"))), t="고의 과실 자백") == "형법"
    assert one(spark, issues.category(issues.direct_issues(F.col("t"))), t="없음") == "일반"
    records = spark.createDataFrame([("영장 영장",), ("영장 자백",), (None,)], "t string")
    assert [(r.term, r.n) for r in issues.weak_keywords(records, F.col("t"), 2).collect()] == [("영장", 2), ("자백", 1)]


def test_merge_pages(spark):
    pages = [
        ("a", 1, "공통 머리글 줄\n원심은 피고인의 행위가 위법하다고 보아 이를"),
        ("a", 2, "공통 머리글 줄\n12 / 30\n유죄로 인정하였다.\n끝"),  # one character: noise
        ("a", 3, "대법원 2020. 1. 2. 선고 2019도123\n전원합의체 판결"),
        ("b", 1, None),
    ]
    got = {r.doc: r.text for r in clean.merge_pages(spark.createDataFrame(pages, "doc string, page int, text string"), "doc", "page", "text").collect()}
    assert got["a"] == "대법원 2020. 1. 2. 선고 2019도123\n전원합의체 판결 공통 머리글 줄\n원심은 피고인의 행위가 위법하다고 보아 이를 유죄로 인정하였다."
    assert got["b"] == ""
    assert not clean.joins("판결하였다", "이를 본다") and not clean.joins("어떤 것이", "[1] 항목") and clean.joins("어떤 것을", "본다는 것")


def test_quiz(spark):
    from quillspark.operators import quiz

    assert one(spark, quiz.negate(F.col("t")), t="이는 죄에 해당한다. 해당한다") == "이는 죄에 해당하지 않는다. 해당한다"
    assert one(spark, quiz.negate(F.col("t")), t="아무것도") is None
    lines = F.array(F.lit("첫 문장은 그대로 옳다."), F.lit("둘째는 적용된다."), F.lit("셋째 문장이다."), F.lit("넷째 문장이다."))
    items = one(spark, quiz.quiz_items(lines, F.array(F.lit("고의")), 4), t="")
    assert [i.answer for i in items] == [True, False, True, False]
    assert items[1].statement == "둘째는 적용되지 않는다." and "고의 와 무관한" in items[3].statement
    assert len(one(spark, quiz.quiz_items(F.array().cast("array<string>"), F.array(F.lit("고의")), 4), t="")) == 1


def test_grounded_answer(spark):
    from quillspark.plans import answers

    rows = [
        ("2020도1", "가 사건", "형법", "위법성이 문제이다.", "고의가 인정된다.", None, dt.datetime(2024, 1, 1)),
        ("2021도2", "나 사건", "형법", "위법성이 문제이다.", None, "시험", dt.datetime(2024, 1, 2)),
    ]
    cases = spark.createDataFrame(rows, "case_number string, case_name string, subject string, issue_summary string, holding_summary string, exam_points string, updated_at timestamp")
    got = answers.answer(cases, "위법성이 문제이다", "summary").first()
    assert got.answer.startswith("[2021도2] 나 사건") and len(got.citations) == 2 and got.safety_flags == []
    assert answers.answer(cases, "2020도1", "summary").first().answer == "[2020도1] 가 사건 사건은 위법성이 문제이다. 쟁점에 대해 고의가 인정된다. 라고 판단한 판례이다."
    none = answers.answer(cases, "없는 말", "qa").first()
    assert none.safety_flags == ["insufficient_evidence"] and none.citations == []
    with pytest.raises(ValueError, match="two characters"):
        answers.answer(cases, " a ", "qa")


def test_judgment(spark):
    from quillspark.operators import judgment

    text = (
        "【판시사항】\n[1] 영장 없는 압수의 적법 여부(소극) / 그 증거의 증거능력 유무(한정 적극)\n[2] 자백의 임의성(적극)\n"
        "[판결요지] 짧다\n【판결요지】\n[1] [다수의견] 위법하다고 본다. [대법관 가의 반대의견] 적법하다.\n[2] 임의성이 있다.\n"
        "<참조조문> 형사 소송법 제308조, 헌법 제12조\n참조판례\n대법원 2012도 1234 판결, 2012도1234, 2010헌마5\n이 유\n끝"
    )
    docs = spark.createDataFrame([(1, text), (2, None), (3, "【요지】\n○ (쟁점①) 무효인지(적극) - 무효라고 보아야 한다\n○ 짧음")], "id long, text string")
    got = {r.id: r for r in judgment.parse_judgments(docs, "id", "text").collect()}
    r = got[1]
    assert r.issues == ["영장 없는 압수의 적법 여부(소극)", "그 증거의 증거능력 유무(한정 적극)", "자백의 임의성(적극)"]
    assert r.polarities == ["negative", "limited_positive", "positive"]
    assert [(h.issue_no, h.opinion) for h in r.holdings] == [(1, "majority"), (1, "dissent"), (2, "unspecified")]
    assert r.acts == ["형사소송법", "헌법"] and r.has_reasoning and r.has_opinions
    assert got[2].issues == [] and got[2].statutes == ""
    assert got[3].issues == ["무효라고 보아야 한다"] and got[3].polarities == ["positive"]


@pytest.mark.parametrize(
    ("text", "path"),
    [
        ("짧다", ""),
        ("피고인이 타인의 지갑을 절도한 사건이다", "형법"),
        ("재산범죄 가운데 절도의 미수", "형법 > 재산범죄 > 절도"),
        ("수사기관이 영장 없이 압수한 것의 효력", "형사소송법 > 압수·수색 > 영장집행"),
        ("아무 관련이 없는 문장입니다", ""),
        ("공판 절차에 관한 긴 문장입니다", "형사소송법"),
    ],
)
def test_taxonomy(spark, text, path):
    assert one(spark, classify.taxonomy_path(F.col("t")), t=text) == path


def test_study_class(spark):
    got = one(spark, classify.study_class(F.col("t")), t="형사소송법상 형법 문제")
    assert got.name == "criminal_procedure"
    assert one(spark, classify.study_class(F.col("t")), t="형사소송법 및 형법제1조의 고의").name == "criminal_law"
    assert one(spark, classify.study_class(F.col("t")), t="헌법상 헌법적").name == "general"


def test_blended_against_brute_force(spark):
    from quillspark.plans.text import _blended

    texts = ["절도 고의 alpha beta gamma", "alpha alpha alpha alpha zeta eta theta iota", "절도 사건 alpha beta", "고의 절도 alpha beta gamma", "nothing like it", None, "절도"]
    b = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    tokens = [[w for w in (t or "").split() if len(w) > 1 and w not in vocab.STOPWORDS] for t in texts]
    idf = {w: np.log((len(texts) + 1) / (sum(w in t for t in tokens) + 1)) + 1 for t in tokens for w in t}
    weights = [{w: t.count(w) / len(t) * idf[w] for w in t} for t in tokens]
    norm = [np.sqrt(sum(x * x for x in w.values())) for w in weights]
    want = {}
    for i, t in enumerate(tokens):
        cos = sum(x * weights[0].get(w, 0) for w, x in weights[i].items()) / (norm[i] * norm[0]) if norm[i] else 0.0
        jac = len(set(t) & set(tokens[0])) / len(set(t) | set(tokens[0]))
        hits = sum(k in (texts[i] or "") for k in ("절도", "고의")) / 2
        score = 0.65 * cos + 0.25 * jac + 0.10 * hits
        if score > 0.30:
            want[i] = round(score, 6)
    got = {r.item_id: r.score for r in _blended(b, b.orderBy("item_id").first()).collect()}
    assert got.keys() == want.keys() and 1 < len(want) < len(texts)
    assert all(abs(got[i] - want[i]) < 2e-6 for i in want)


def test_cases_hold_the_whole_text(spark):
    from quillspark.plans.answers import retrieve
    from quillspark.plans.text import _cases

    asked = "needle phrase"
    places = (10, 393, 650, 795, 1187)  # two of them across the borders of the thirds
    rows = [(n, "x" * at + asked + "y" * (1200 - at - len(asked)), "s", "en") for n, at in enumerate(places)]
    docs = spark.createDataFrame([*rows, (9, "z" * 1200, "s", "en"), (10, None, "s", "en")], "doc_id long, text string, source string, lang string")
    assert {r.case_number for r in retrieve(_cases(docs), asked, 10).collect()} == {f"2024도{n}" for n in range(len(places))}
