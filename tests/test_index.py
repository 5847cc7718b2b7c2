"""The stored inverted index, and the index of character triples, against plain loops."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillspark.functions import vocab
from quillspark.operators import grams, inverted, tfidf

SCHEMA = "id long, text string, at timestamp"
WORDS = [f"w{k}" for k in range(40)] + ["표현의", "자유", "a"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    made = [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 15))), dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 9))) for k in range(n)]
    return [*made, (n, None, None), (n + 1, "", made[0][2]), (n + 2, made[0][1], None), (n + 3, "a b", None)]


def brute(rows):
    tokens = {i: [w for w in (t or "").split() if len(w) > 1 and w not in vocab.STOPWORDS] for i, t, _ in rows}
    df = {w: sum(w in t for t in tokens.values()) for t in tokens.values() for w in t}
    idf = {w: math.log((len(rows) + 1) / (n + 1)) + 1 for w, n in df.items()}
    vectors = {i: {w: t.count(w) / len(t) * idf[w] for w in t} for i, t in tokens.items()}
    return idf, vectors


def cosine(a, b):
    length = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
    return sum(x * b.get(w, 0.0) for w, x in a.items()) / length if length else 0.0


def best(vectors, query, k, without=None):
    scored = sorted(((round(cosine(query, v), 9), i) for i, v in vectors.items() if i != without), key=lambda x: (-x[0], x[1]))
    return [(i, round(s, 4)) for s, i in scored[:k]]


def query_vector(idf, text):
    tokens = text.split()
    return {w: tokens.count(w) / len(tokens) * idf[w] for w in tokens if w in idf}


def made(spark, path, parts):
    for rows in parts:
        index = inverted.add(path, spark.createDataFrame(rows, SCHEMA), "id", F.col("text"), F.col("at"))
    return index


@pytest.mark.parametrize("cuts", [[], [50], [1, 2, 90]])
def test_segments_give_what_one_gives(spark, tmp_path, cuts):
    rows = corpus(100)
    ends = [0, *cuts, len(rows)]
    index = made(spark, str(tmp_path / "i"), [rows[a:b] for a, b in zip(ends, ends[1:], strict=False)])
    assert index.n_docs == len(rows) and len(index.segments) == len(cuts) + 1
    idf, vectors = brute(rows)
    assert {r.term: round(r.idf, 9) for r in inverted.idf_table(index).collect()} == {w: round(x, 9) for w, x in idf.items()}
    for target in (0, 7, 100, 102):
        assert [(r.doc, r.similarity) for r in inverted.similar(index, target, 8).collect()] == best(vectors, vectors[target], 8, target)
    assert inverted.similar(index, 12345, 5).count() == 0
    text = "w1 w1 w7 unknown 자유"
    query = query_vector(idf, text)
    assert [(r.doc, r.similarity) for r in inverted.search(index, text, 7).collect()] == [x for x in best(vectors, query, 7) if x[1] > 0]
    far = sorted((round(math.sqrt(sum((v.get(w, 0) - query.get(w, 0)) ** 2 for w in {*v, *query})), 9), i) for i, v in vectors.items())[:6]
    assert [(r.doc, round(r.distance, 5)) for r in inverted.nearest(index, text, 6).collect()] == [(i, round(x, 5)) for x, i in far]
    assert inverted.search(index, "unknown", 5).count() == 0 == inverted.search(index, "", 5).count()


def test_newest_is_a_filter(spark, tmp_path):
    rows = corpus(100)
    index = made(spark, str(tmp_path / "i"), [rows[:60], rows[60:]])
    last = sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0]), reverse=True)[:30]
    assert {r.doc for r in inverted.newest(index, 30).collect()} == {i for i, _, _ in last}
    _, vectors = brute(last)
    target = last[4][0]
    assert [(r.doc, r.similarity) for r in inverted.similar_among(inverted.newest(index, 30), target, 6).collect()] == best(vectors, vectors[target], 6, target)
    absent = next(r[0] for r in rows if r not in last)
    assert inverted.similar_among(inverted.newest(index, 30), absent, 6).count() == 0


def test_a_query_reads_its_buckets(spark, tmp_path):
    index = made(spark, str(tmp_path / "i"), [corpus(50)])
    query = inverted.text_query(index, "w1 w2")
    read = inverted.dots(index, query)
    plan = read._jdf.queryExecution().executedPlan().toString()
    asked = sorted({int(b) for b in query.buckets})
    assert len(asked) <= 2
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan) and re.search(r"PushedFilters: \[[^\]]*In\(term, \[w1,w2\]", plan)
    files = index.of_terms("postings", ["w1", "w2"], query.buckets).select(F.input_file_name()).distinct().collect()
    assert {int(f[0].split("bucket=")[1].split("/")[0]) for f in files} <= set(asked) and read.count() > 0


def test_nothing_stays_in_memory(spark, tmp_path):
    index = made(spark, str(tmp_path / "i"), [corpus(30)])
    inverted.similar(index, 0, 3).collect()
    inverted.search(index, "w1", 3).collect()
    assert not list(spark.sparkContext._jsc.getPersistentRDDs())


def test_segments_that_were_not_finished_are_not_read(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "i"), corpus(40)
    made(spark, path, [rows[:20]])
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        docs = spark.range(3).select("id", F.lit("w1").alias("text"), F.lit(None).cast("timestamp").alias("at"))
        with pytest.raises(RuntimeError):
            inverted.add(path, docs.withColumn("id", F.col("id") + 900), "id", F.col("text"))
    index = made(spark, path, [rows[20:]])
    idf, vectors = brute(rows)
    assert [(r.doc, r.similarity) for r in inverted.similar(index, 3, 9).collect()] == best(vectors, vectors[3], 9, 3)


def test_known_documents_and_names_come_once(spark, tmp_path):
    path, rows = str(tmp_path / "i"), corpus(20)
    made(spark, path, [rows, rows[:5], [(500, "w1 w2", None)]])
    index = inverted.open_index(spark, path)
    assert index.n_docs == len(rows) + 1
    docs = spark.createDataFrame([(600, "w3", None), (None, "w3", None)], SCHEMA)
    assert inverted.add(path, docs, "id", F.col("text"), name="third").n_docs == len(rows) + 2
    with pytest.raises(AnalysisException):
        inverted.add(path, docs.withColumn("id", F.col("id") + 1), "id", F.col("text"), name="third")
    assert inverted.open_index(spark, path).n_docs == len(rows) + 2


def test_an_index_of_nothing(spark, tmp_path):
    assert inverted.open_index(spark, str(tmp_path / "none")) is None
    index = made(spark, str(tmp_path / "i"), [[]])
    assert index.n_docs == 0 and inverted.search(index, "w1 w2", 3).count() == 0 and inverted.similar(index, 1, 3).count() == 0
    index = made(spark, str(tmp_path / "i"), [[(1, None, None)], [(2, "w1 w1", None)]])
    assert [r.doc for r in inverted.search(index, "w1", 3).collect()] == [2]
    assert [(r.doc, r.similarity) for r in inverted.similar(index, 1, 3).collect()] == [(2, 0.0)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = [(k, rng.choice("ab"), "".join(rng.choice("xyzXY 가나é😀") for _ in range(rng.randint(0, 40)))) for k in range(120)]
    return [*made, (5, "a", "another text of a field"), (5, "a", "another text of a field"), (6, "b", None), (None, "a", "xyz"), (7, "b", "percent 100%_ sign"), (8, "a", "x" * 5000 + "needle")]


@pytest.mark.parametrize("needle", ["xyz", "XY가", "😀가", "é x", "x", "", "no such", "100%_", "xxxxneedle", "text of", "가나"])
def test_substrings(spark, tmp_path_factory, texts, needle):
    path = tmp_path_factory.getbasetemp() / "grams"
    if not path.exists():
        grams.write(str(path), spark.createDataFrame(texts, "k long, f string, t string"), "k", "f", "t", buckets=8)
    index = grams.Grams(spark, str(path), 8, "bigint")
    want = {(k, f) for k, f, t in texts if k is not None and t is not None and needle.lower() in t.lower()}
    assert {tuple(r) for r in grams.containing(index, needle).collect()} == want
    assert {tuple(r) for r in grams.containing(index, needle, ["b"]).collect()} == {x for x in want if x[1] == "b"}
    found = grams.candidates(index, needle)
    assert (found is None) == (len(needle) < 3)
    if found is not None:
        assert {tuple(r) for r in found.collect()} >= want and found.count() <= len(want) + 40


def test_a_search_reads_its_triples(spark, tmp_path, texts):
    index = grams.write(str(tmp_path / "g"), spark.createDataFrame(texts, "k long, f string, t string"), "k", "f", "t", buckets=16)
    plan = grams.candidates(index, "xyz")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan) and re.search(r"PushedFilters: \[[^\]]*(In\(gram, \[xyz|EqualTo\(gram,xyz)", plan)
    assert not grams.write(str(tmp_path / "e"), spark.createDataFrame([], "k long, f string, t string"), "k", "f", "t").read("texts").count()


def test_retrieval_by_index_is_that_by_scan(spark):
    from quillspark.plans.answers import SUMMARIES, retrieve
    from quillspark.plans.text import _cases

    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(["절도", "고의", "alpha", "beta gamma", "2024도3"], k=20)), "name alpha", "en") for k in range(30)]
    cases = _cases(spark.createDataFrame([*rows, (30, None, None, None)], "doc_id long, text string, source string, lang string"))
    from quillspark.sources.shared import new_folder

    index = grams.write(new_folder(spark), grams.long_rows(cases, "case_number", ["case_number", "case_name", *SUMMARIES]), "doc", "field", "text")
    for question in ("beta gamma", "2024도3", "절도 고의", "a", "nothing at all 2024도12", "alpha"):
        assert retrieve(cases, question, 10, index).collect() == retrieve(cases, question, 10).collect()


def test_lines_are_numbered_across_splits(spark, tmp_path, monkeypatch):
    from quillspark.sources.numbering import numbered_lines

    for name, n in (("a", 3000), ("b", 1), ("c", 777), ("empty", 0)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {k}{' x' * (k % 30)}\n" if k % 7 else "\n" for k in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = numbered_lines(spark, str(tmp_path)).collect()
        plan = numbered_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3778 and "Window" not in plan
    for r in rows:
        assert (r.line == "") if r.line_no % 7 == 0 else r.line.split()[:2] == [r.file.rsplit("/", 1)[1][:-4], str(r.line_no)]


def test_texts_and_counts_of_a_document_are_not_shuffled(spark, tmp_path):
    """Tokens are counted where a document is read: the plans deal out nothing by document."""
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, None), (3, "cc aa")], "doc_id long, text string")
    made = tfidf.weights(docs, "doc_id", "text")
    assert "hashpartitioning(doc" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc, r.term, round(r.tf, 6)) for r in made.collect()} == {(1, "aa", 0.666667), (1, "bb", 0.333333), (3, "aa", 0.5), (3, "cc", 0.5)}
    twice = docs.union(docs.filter("doc_id = 1"))  # rows of one id are still counted together
    assert {(r.doc, r.term, r.tf) for r in tfidf.weights(twice, "doc_id", "text").collect() if r.doc == 1} == {(1, "aa", 4 / 3), (1, "bb", 2 / 3)}
    index = inverted.add(str(tmp_path / "i"), docs, "doc_id", F.col("text"))
    rows = {r.doc: (r.len, [tuple(p) for p in r.vector] if r.vector else None) for r in index.read("documents").collect()}
    assert rows == {1: (3, [("aa", 2), ("bb", 1)]), 2: (0, None), 3: (2, [("aa", 1), ("cc", 1)])}


def test_triples_are_dealt_by_bucket_and_repeated_texts_change_nothing(spark, tmp_path):
    text = "Die 가나다 😀x😀y abcabcabd"
    df = spark.createDataFrame([(text,)], "t string")
    whole = df.select(F.explode(grams.grams(F.col("t"))).alias("g")).collect()
    dealt = df.select(F.inline(grams._dealt(grams.grams(F.col("t")), 4))).collect()
    assert len(dealt) == len({r.bucket for r in dealt}) <= 4  # a row for a bucket, not for a triple
    assert sorted(r.run[i : i + 3] for r in dealt for i in range(0, len(r.run), 3)) == sorted(r.g for r in whole)
    rows = spark.createDataFrame([("a", "t", "abcdef"), ("a", "t", "abcdef"), ("b", "t", "abc"), ("b", "t", "bcdef"), ("c", "u", "xx"), ("d", "u", text)], "doc string, field string, text string")
    for unique in (False, True):
        index = grams.write(str(tmp_path / f"g{unique}"), rows, "doc", "field", "text", unique=unique)
        found = lambda needle: sorted(tuple(r) for r in grams.containing(index, needle).collect())  # noqa: B023, E731
        assert found("abcdef") == [("a", "t")]
        assert found("BCD") == [("a", "t"), ("b", "t")]
        assert found("😀x😀") == [("d", "u")]
        assert found("xx") == [("c", "u")]
