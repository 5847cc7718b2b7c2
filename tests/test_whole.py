"""Queries that look at all of their table."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import digest, grams, judgment
from quillspark.plans import answers, storage, text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_the_oldest_case_is_found_as_well(spark, tmp_path):
    """The newest of 900 cases is a copy of the first one; some have no text or no token."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(400)], k=rng.randint(3, 30))) for _ in range(900)]
    texts[5], texts[6], texts[-1] = None, "", texts[0]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in text.similar_cases(spark, str(tmp_path)).select("doc", "similarity", "rank").collect()]
    assert got[0][0] == "2024도0"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == con.execute(text.SQL["similar_cases"]).fetchall()
    assert text.similar_cases(spark, str(tmp_path), "2024도901").count() == 0
    assert text.similar_cases(spark, str(tmp_path), "2024도6", 2).count() == 2  # has its name and language alone


def test_one_question_writes_no_index_and_retrieves_once(spark, monkeypatch):
    asked, retrieve = [], answers.retrieve
    monkeypatch.setattr(grams, "write", lambda *a, **b: 1 / 0)
    monkeypatch.setattr(answers, "retrieve", lambda *a, **b: (asked.append(a[1]), retrieve(*a, **b))[1])
    monkeypatch.setattr(storage, "_GRAMS", {})
    found = storage.grounded_texts(spark, "/root/testdata/sf0.001")
    assert {r.intent for r in found.collect()} == set(storage.INTENTS) and asked == ["2024도7"]


def test_patterns_of_hangul_stop_where_it_ends(spark):
    """Sections, facts and sentences from the reach of Hangul are those of the whole text, and the reach doesn't grow with what follows."""
    rng = random.Random(9)
    parts = ["【판시사항】", "[이 유]", "\n주 문 :  \n", "\n사건\n", "사 건\n2024도12 절도", "2019 도 33", "〈가나가 문제된 사건〉", "영장이 위법하다. ", "<b é>", "[x y z]", "the of, 12. and\n", "on. 3 \n\n", " ", "\t", "é1 "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) + rng.choice(["", "   \n ", "]\n", "】 ", "7 8 9", " a"]) + "".join(rng.choices(parts[8:], k=rng.randint(0, 60))) for _ in range(300)]
    texts += ["", "no syllable at all", "【판결요지】\n[1] 유죄" + " word [1] x\n" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t, more, lines = F.col("t"), X.reach(F.col("t"))["more"], X.reach(F.col("t"))["lines"]
    same = lambda of: of(more).eqNullSafe(of(t))
    hangul = lambda c: F.filter(digest.candidate_sentences(c, F.lit("")), lambda s: s.rlike("[가-힣]"))
    checks = {"number": same(digest.case_number), "subject": same(digest.subject), "court": same(digest.court), "sentences": hangul(lines) == hangul(t)}
    assert rows.filter(~F.array_min(F.array(*checks.values()))).count() == 0
    for r in rows.select("t", judgment.sections(t).alias("s"), F.length(more).alias("n")).collect():
        names = [re.sub(r"[\s:：【】\[\]〔〕<>]", "", m) for m in re.findall(judgment.MARKER, r.t)]
        assert [(x.name, x.body) for x in r.s] == list(zip(names, re.split(judgment.MARKER, r.t)[1:], strict=True))
        assert r.n < 1500
