"""Exact rounding, the join of the most similar, key sentences and their evaluation, against plain loops."""

import json
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import vocab
from quillspark.functions.rounding import round_exact
from quillspark.operators import inverted, textrank, topk
from quillspark.plans import answers
from quillspark.sources.shared import new_folder


@pytest.mark.parametrize("digits", [0, 2, 4, 9])
def test_rounding_is_that_of_the_binary_value(spark, digits):
    rng = random.Random(digits)
    values = [2.675, 0.125, 0.375, 1e-5, 5e-5, 1.5, 2.5, 0.5, -0.5, -2.675, 0.0, 1e22, 4503599627370497.5, 2.0**52 + 0.5, 1e300, 5e-324, 0.1, 123456789.123456789, 0.00005, 1.00005, 4.5e11 + 0.00005]
    values += [rng.uniform(-10, 10) for _ in range(500)] + [rng.randint(-(10**6), 10**6) / 2 ** rng.randint(1, 12) for _ in range(500)]
    values += [(2 * rng.randint(0, 10**7) + 1) / (2 * 10**digits) for _ in range(500)] + [math.ldexp(rng.random(), rng.randint(-60, 60)) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_exact(F.col("v"), digits).alias("r")).collect()
    assert [(r.v, r.r) for r in got if r.r != round(r.v, digits)] == []
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("nan"),)], "v double").select(round_exact(F.col("v"), digits).alias("r")).collect()
    assert odd[0].r is None and odd[1].r == float("inf") and math.isnan(odd[2].r)


def most_similar(texts, k):
    tokens = {i: [w for w in (t or "").split() if len(w) > 1] for i, t in texts}
    df = {w: sum(w in t for t in tokens.values()) for t in tokens.values() for w in t}
    units = {}
    for i, t in tokens.items():
        v = {w: t.count(w) / len(t) * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) for w in t}
        length = math.sqrt(sum(x * x for x in v.values()))
        units[i] = {w: x / length for w, x in v.items()}
    want = set()
    for i, a in units.items():
        scored = sorted((-round(sum(x * b.get(w, 0.0) for w, x in a.items()), 9), j) for j, b in units.items() if j != i)
        want |= {(i, n + 1, j, round(-s, 4)) for n, (s, j) in enumerate(x for x in scored[:k] if x[0] < 0)}
    return want


@pytest.mark.parametrize("k", [1, 3])
def test_most_similar_of_all(spark, k):
    rng = random.Random(k)
    common, names = [f"common{j}" for j in range(6)], [f"w{j}" for j in range(150)]
    texts = [" ".join(rng.choices(common, k=rng.randint(1, 10)) + rng.choices(names, k=rng.randint(0, 8))) for _ in range(90)]
    texts += texts[:4] * 5 + ["lonely words here", "lonely", "", None, "a b c", " ".join(common)]  # copies, one alone, no token
    base = rng.choices(names, k=30)
    texts += [" ".join([*base[:j], f"x{j}", *base[j + 1 :]]) for j in range(25)]  # near copies
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    index = inverted.add(new_folder(spark), spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"))
    got = topk.top_similar(index.read("documents").select("doc", "len", "vector"), index.n_docs, k)
    assert {tuple(r) for r in got.collect()} == most_similar(rows, k)


def test_no_pairs_of_what_cannot_be_best(spark, monkeypatch):
    """A hot word in all documents is no list that is joined, and copies are compared once."""
    rng = random.Random(4)
    texts = [f"everywhere {' '.join(f'g{g}n{rng.randint(0, 9)}' for _ in range(6))}" for g in range(60) for _ in range(5)] + ["the very same text"] * 300
    index = inverted.add(new_folder(spark), spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", F.col("text"))
    made = []
    stored = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path, *a, **b: (stored(self, path, *a, **b), made.append(spark.read.parquet(path).columns and (spark.read.parquet(path).columns, spark.read.parquet(path).count())))[0])
    topk.top_similar(index.read("documents").select("doc", "len", "vector"), index.n_docs, 3)
    sums = [n for columns, n in made if columns == ["c", "o", "s"]]
    assert sums and max(sums) < 300 * 30  # of 300 * 299 pairs


@pytest.mark.parametrize(("entries", "dense", "at_once"), [(1 << 20, 2048, 1 << 22), (60, 3, 7), (200, 0, 50)])
def test_pairs_of_blocks_are_no_rows(spark, monkeypatch, entries, dense, at_once):
    """Every document shares words with every other: what is stored grows with the documents all the same."""
    for name, value in (("ENTRIES", entries), ("DENSE", dense), ("AT_ONCE", at_once)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(30)], k=rng.randint(4, 25)))) for i in range(150)]
    index = inverted.add(new_folder(spark), spark.createDataFrame(rows, "id long, text string").coalesce(2), "id", F.col("text"))
    made = []
    stored = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path, *a, **b: (stored(self, path, *a, **b), made.append((spark.read.parquet(path).columns, spark.read.parquet(path).count())))[0])
    got = topk.top_similar(index.read("documents").select("doc", "len", "vector").coalesce(1), index.n_docs, 2)
    sums = [n for columns, n in made if columns == ["c", "o", "s"]]
    assert sums and max(sums) <= 150 * 2 * 4  # of 150 * 149 pairs
    assert {tuple(r) for r in got.collect()} == most_similar(rows, 2)


def plain_ranks(sets):
    n = len(sets)
    m = np.array([[0 if i == j or not (a | b) else len(a & b) / len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    s = np.ones(n) / n
    for _ in range(30):
        t = 0.15 / n + 0.85 * m.T @ s
        if np.allclose(s, t, atol=1e-6):
            break
        s = t
    return s


@pytest.mark.parametrize(("held", "step"), [(1 << 24, 1 << 22), (50, 40), (0, 1)])
def test_ranks_of_random_sentences(monkeypatch, held, step):
    monkeypatch.setattr(textrank, "HELD", held)
    monkeypatch.setattr(textrank, "AT_ONCE", step)
    rng = random.Random(1)
    for n in (1, 2, 7, 40):
        sets = [set(rng.choices("abcdefghijklmnop", k=rng.randint(0, 6))) for _ in range(n)]
        assert np.allclose(textrank.ranks(sets), plain_ranks(sets))


def test_many_sentences_take_no_time():
    rng = random.Random(2)
    sets = [{f"w{int(rng.paretovariate(0.5)) % 4000}" for _ in range(15)} for _ in range(2100)]
    textrank.ranks(sets[:50])
    start = time.process_time()
    textrank.ranks(sets)
    assert time.process_time() - start < 2.0


PARTS = ["대법원은 형법 제 250 조를 적용하였다", "사건 2019도12345 판결을 선고하였다", "2020. 5. 14. 선고한 결정의 이유이다", "표현의 자유는 기본권이다", "the court said nothing of it", "지방법원의 판단이 옳았음", "절도의 고의가 있었다고 본다"]


def samples(n):
    rng = random.Random(7)
    return [(k, rng.choice(["\n", ". ", " "]).join(rng.choices(PARTS, k=rng.randint(1, 12)))) for k in range(n)] + [(n, None), (n + 1, "")]


def test_evaluation(spark, tmp_path):
    rows = samples(60)
    made = answers.evaluated(spark.createDataFrame(rows, "id long, text string"), "id", "text", 6, 3)
    got = {r.id: r for r in made.collect()}
    patterns = [re.compile(p) for p in vocab.LEGAL_PATTERNS]
    clean = {str(r.id): r.t for r in spark.createDataFrame(rows, "id long, text string").select("id", X.normalize_legal(F.col("text")).alias("t")).collect()}
    for i, r in got.items():
        count = lambda t: tuple(sum(1 for _ in p.finditer(t)) for p in patterns)
        assert tuple(r.original_signals) == count(clean[i]) and tuple(r.summary_signals) == count(r.key_sentences)
        total = sum(count(clean[i]))
        assert r.signal_retention == (round(sum(count(r.key_sentences)) / total, 4) if total else 0.0)
        assert len(r.keywords) <= 6 and r.key_sentences.count("\n") <= 2
    assert len(got) == 62 and 0 < np.mean([r.signal_retention for r in got.values()]) < 1
    out = answers.evaluation(made, str(tmp_path / "samples")).first()
    mean = lambda f, digits: round(sum(map(f, got.values())) / len(got), digits)
    assert out.samples == 62 and abs(out.avg_signal_retention - mean(lambda r: r.signal_retention, 4)) < 1.1e-4
    assert (out.avg_keyword_count, out.avg_key_sentence_length) == (mean(lambda r: len(r.keywords), 2), mean(lambda r: len(r.key_sentences), 2))
    said = [json.loads(line) for f in (tmp_path / "samples").glob("*.json") for line in f.read_text().splitlines()]
    assert {s["id"]: s["key_sentences"] for s in said} == {i: r.key_sentences for i, r in got.items()}
    assert tuple(answers.evaluation(made.limit(0)).first()) == (0, 0.0, 0.0, 0.0)


STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electriciti": "electr", "goodness": "good", "revival": "reviv", "airliner": "airlin",
    "gyroscopic": "gyroscop", "replacement": "replac", "adoption": "adopt", "homologous": "homolog", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "a": "a", "": "", "as": "as", "don't": "don't", "한국어": "한국어",
}


def test_stems_are_those_published(spark, monkeypatch):
    from quillspark.functions import stem

    monkeypatch.setattr(stem, "KNOWN", 7)
    rows = spark.createDataFrame([(list(STEMS),), ([],), (None,)], "w array<string>").select(stem.stems(F.col("w")).alias("s")).collect()
    assert rows[0].s == list(STEMS.values()) and rows[1].s == [] and rows[2].s is None


@pytest.mark.parametrize("reduced", [False, True])
@pytest.mark.parametrize("few", [0, 100])
def test_query_frequencies(spark, monkeypatch, reduced, few):
    from quillspark.functions.stem import porter
    from quillspark.operators import experiment

    monkeypatch.setattr(experiment, "BROADCAST_WORDS", few)
    rng = random.Random(3)
    texts = [(k, " ".join(rng.choices(["Turkish", "coffee,", "coffees", "tea", "grounds!", "running"], k=rng.randint(0, 9)))) for k in range(40)] + [(40, None)]
    queries = ["turkish coffee", "coffee coffee ground run", "nothing", ""]
    words = lambda t: [(porter(w) if reduced else w) for w in re.sub("[,!]", "", (t or "").lower()).split()]
    want = {}
    for q in queries:
        for i, t in texts:
            n = sum(words(t).count(w) for w in words(q))
            if n:
                want[q, i] = (n, len(words(t)), {w: words(t).count(w) for w in words(q) if w in words(t)})
    made = experiment.query_frequencies(spark.createDataFrame(texts, "i long, t string"), "i", "t", spark.createDataFrame([(q,) for q in queries], "query string"), reduced)
    assert {(r.query, r.doc): (r.n, r.length, r.by_word) for r in made.collect()} == want


def test_pooled_vectors(spark):
    from quillspark.operators import experiment

    vectors = {"ab": [1.0, 0.0, 2.0], "cd": [0.0, 3.0, 0.0], "x": [9.0, 9.0, 9.0], "12": [9.0, 9.0, 9.0], "zz": [0.0, 0.0, 0.0]}
    texts = [(0, "ab ab cd unknown x 12"), (1, "cd"), (2, "unknown"), (3, None), (4, "zz"), (5, "zz ab")]
    made = experiment.pooled_vectors(spark.createDataFrame(texts, "i long, t string"), "i", "t", spark.createDataFrame(list(vectors.items()), "word string, vector array<float>"))
    got = {r.doc: r.vector for r in made.collect()}
    unit = lambda v: (np.array(v) / np.linalg.norm(v)).tolist()
    assert got.keys() == {0, 1, 5}
    assert np.allclose(got[0], unit([2, 3, 4])) and np.allclose(got[1], [0, 1, 0]) and np.allclose(got[5], unit([1, 0, 2]))


def test_all_dictionaries_in_one_pass(spark):
    from quillspark.functions import patterns
    from quillspark.operators import classify, issues
    from quillspark.plans.text import LINES

    rng = random.Random(9)
    texts = [" ".join(rng.choices([*LINES, *classify.DOMAIN_WORDS, *classify.CLASS_WORDS, "형사소송법 형법제1조", "Ox", "http://x.y/영장"], k=rng.randint(0, 6))) for _ in range(200)] + [None, "", "x" * 100_000 + "영장"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    t = F.col("t")
    one_by_one = df.select("i", classify.study_domain(t).alias("domain"), classify.study_class(t).alias("class"), issues.direct_issues(t).alias("direct"))
    assert classify.labelled(df, "i", "t").orderBy("doc").collect() == one_by_one.withColumnRenamed("i", "doc").orderBy("doc").collect()
    words = ["a", "ab", "bab", "가나", "나"]
    odd = ["abab", "b", "가나가", "", None, "xyz" * 1000 + "bab"]
    got = spark.createDataFrame([(x,) for x in odd], "t string").select(patterns.scan(F.col("t"), words).alias("n")).collect()
    assert [r.n for r in got] == [[k for k, w in enumerate(words) if w in (x or "")] for x in odd]


def test_weak_keywords_are_counted_once_a_record(spark):
    from quillspark.operators import issues

    rng = random.Random(2)
    records = [" ".join(rng.choices([*issues.KEYWORDS[:8], "nothing"], k=rng.randint(0, 5))) for _ in range(100)] + [None]
    counts = {k: sum(k in (r or "") for r in records) for k in issues.KEYWORDS}
    want = sorted(((k, n) for k, n in counts.items() if n), key=lambda x: (-x[1], x[0]))[:4]
    assert [tuple(r) for r in issues.weak_keywords(spark.createDataFrame([(r,) for r in records], "t string"), F.col("t"), 4).collect()] == want


def test_pooled_vectors_move_no_vector_for_each_word_of_a_document(spark):
    from quillspark.operators import experiment

    docs = spark.createDataFrame([(i, f"aa b{i % 3} cc aa 12 z") for i in range(40)], "i long, t string")
    vectors = spark.createDataFrame([("aa", [1.0, 0.0]), ("b0", [0.0, 1.0]), ("b1", [3.0, 4.0])], "word string, vector array<float>")
    made = experiment.pooled_vectors(docs, "i", "t", vectors)
    assert "FlatMapCoGroups" in made._jdf.queryExecution().optimizedPlan().toString()  # vectors meet chunks of documents
    want = {0: (2.0, 1.0), 1: (5.0, 4.0), 2: (2.0, 0.0)}
    rows = {r.doc: r.vector for r in made.collect()}
    assert len(rows) == 40
    for i, v in rows.items():
        x, y = want[i % 3]
        assert v == pytest.approx([x / (x * x + y * y) ** 0.5, y / (x * x + y * y) ** 0.5])
    keyed = spark.createDataFrame([(2, [1.0, 1.0])], "word long, vector array<double>")
    by_length = experiment.pooled_vectors(docs, "i", "t", keyed, lambda w: w.substr(1, 0).isNull().cast("long") + 2)
    assert {tuple(round(x, 6) for x in r.vector) for r in by_length.collect()} == {(0.707107, 0.707107)}
