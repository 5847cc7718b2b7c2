import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

from .fixtures import SCHEMA, documents, stable
from .test_dedup import brute


def prose(rng, n):
    return " ".join(rng.choice("the house of water and is in a great old river stone".split()) + rng.choice("abcdefghij") for _ in range(n))


@pytest.fixture
def rows(spark):
    rng = random.Random(8)
    base = [prose(rng, rng.randint(20, 90)) for _ in range(60)]
    near = [b.replace(b.split()[5], "changed", 1) for b in base[:10] if len(b.split()) > 70]
    made = [(1000 + i, t, "en", "s", 1) for i, t in enumerate([*base, *near, *base[:15], *(b.replace(" ", "\n ") for b in base[20:25])])]
    made.append((3000, "write to ana.b@mail.org or 10.2.3.4 " + prose(rng, 60), "en", "s", 1))
    return documents(spark).unionByName(spark.createDataFrame(made, SCHEMA))


def test_stages_on_odd_rows(spark, tmp_path, rows):
    odd = rows.withColumns({"row": F.lit(7), "Score": F.lit("mine"), "row_number": F.lit(1), "masked": F.lit(None).cast("int"), "own_Score": F.lit(2)})
    docs = stable(spark, tmp_path, odd)
    for number, (name, stage) in enumerate(C.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == odd.columns, name
        assert {r.Score for r in out.select("Score").distinct().collect()} <= {"mine"}, name
        out.write.parquet(str(tmp_path / f"stage{number}"))
        before, after = docs.collect(), spark.read.parquet(str(tmp_path / f"stage{number}")).collect()
        if name == "language":
            assert all(any(map(str.isalpha, r.text or "")) for r in after) and 0 < len(after) < len(before)
        if name == "exact_dedup":
            normal = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
            least = {}
            for r in before:
                least[normal(r)] = min(least.get(normal(r), (True, 0)), (r.doc_id is None, r.doc_id or 0))
            assert sorted((normal(r), (r.doc_id is None, r.doc_id or 0)) for r in after) == sorted(least.items())
        if name == "ngram_join":
            _, groups = brute(before, 5, 80)
            assert len(after) == groups < len(before)
        if name == "pii":
            assert len(after) == len(before) and not any("@mail.org" in (r.text or "") or "10.2.3.4" in (r.text or "") for r in after)
            assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
        docs = spark.read.parquet(str(tmp_path / f"stage{number}"))
    pieces = C.pack_sequences(spark, docs, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}


def test_run_gives_what_the_stages_give(spark, tmp_path, rows):
    docs = stable(spark, tmp_path, rows)
    want = docs
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, want, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        want = spark.read.parquet(str(tmp_path / f"s{k}"))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, C.run(spark, str(tmp_path)).collect())) == sorted(map(key, want.collect()))


def test_stages_of_an_empty_table_and_of_rows_in_memory(spark, tmp_path):
    empty = stable(spark, tmp_path, spark.createDataFrame([], SCHEMA))
    for name, stage in C.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    memory = spark.createDataFrame([(1, "same text here", "en", "s", 1), (0, "same text here", "en", "s", 1)], SCHEMA)
    assert [r.doc_id for r in C.drop_copies(spark, memory, "").collect()] == [0]
