import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, language, neighbours, pii, secrets

from .fixtures import SCHEMA, documents


def test_pii_base_spans(spark):
    for r in pii.find_pii(documents(spark)).collect():
        want = []
        for kind, pattern in zip(pii.KINDS, (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE), strict=True):
            for m in pattern.finditer(r.text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                    continue
                if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                    continue
                if kind == "phone" and not 10 <= len(digits) <= 15:
                    continue
                want.append((m.start(), pii.KINDS.index(kind), m.end()))
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans if s.base] == sorted(want)
    assert pii.find_pii(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write to ana at mail dot com today", ["email"]),
        ("please call (415) 555-0134 tonight", ["phone"]),
        ("on 2024-01-02 we sold 1234567 units, 12/31/2024", []),
        ("version 1.2.3 costs 300 and 4500 or 12", []),
        ("plain words only", []),
    ],
)
def test_pii_field_adds_spans(text, found):
    assert [s["kind"] for s in pii.find_spans(text, pii.trained()) if not s["base"]] == found


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("write to john [at] mail [dot] com today", "email"),
        ("write to john (at) mail (dot) com today", "email"),
        ("write to john AT mail DOT com today", "email"),
        ("call 415\u00a0555\u00a00134 now", "phone"),
        ("call 415\t555\t0134 now", "phone"),
    ],
)
def test_pii_anchors_of_other_forms(text, kind):
    whole = pii.decode_spans(text, pii.trained(), 0, len(text))
    got = [(s["kind"], s["start"], s["end"]) for s in pii.find_spans(text, pii.trained()) if not s["base"]]
    assert got == whole
    assert pii.stretches(text) and (kind != "email" or [k for k, _, _ in whole] == [kind])


def test_pii_around_anchors_as_the_whole_text():
    rng = random.Random(12)
    weights = np.where(pii.trained() == 0, 0, pii.trained() + 0.5)  # more segments pass
    bits = ["at", "AT", "@", "dot", "DOT", ".", "[", "]", "(", ")", " ", " ", " ", " ", "\t", "\u00a0", "\n", "  ", "-", "+", "/", "_", "john", "mail", "com", "tel", "x" * 70, "\u0663", "\u00b2", "1", "42", "415", "5550134", "4111 1111 1111 1111", "10.2.3.4", "café"]
    some = 0
    for n in range(1500):
        text = "".join(rng.choice(bits) + rng.choice(("", " ")) for _ in range(rng.randint(1, 120)))
        if n % 3 == 0:
            text = " ".join(pii._example(rng)[0].replace(*rng.choice(((" at ", " [at] "), (" dot ", " (DOT) "), (" ", "\u00a0"), ("-", "\t")))) for _ in range(4))
        whole = pii.decode_spans(text, weights, 0, len(text))
        assert [x for lo, hi in pii.stretches(text) for x in pii.decode_spans(text, weights, lo, hi)] == whole, text
        some += len(whole)
    assert some > 500


def test_pii_emails_as_the_pattern():
    for text in ("a@b@c.com x.y+z@d-e.org.", "@a.b", "a@b", "a@b.", "q@w.e@r.t", "..@x.y", "é.a@b.c"):
        assert [m.span() for m in pii._emails(text)] == [m.span() for m in pii.EMAIL.finditer(text)]


def test_masking(spark):
    rows = {r.doc_id: r.text for r in pii.mask_pii(spark.createDataFrame([(1, "to bob@x.org now", None, None, 3), (2, None, None, None, None)], SCHEMA)).collect()}
    assert rows == {1: "to [EMAIL] now", 2: None}


def test_secrets(spark):
    noise = "kT9xQ2vLw8Zr4BnM7pYs3Hd6Jf1Gc5Xa"
    docs = documents(spark).unionByName(spark.createDataFrame([(900, f"see {noise} here zzzzzzzzzzzzzzzzzzzzzzzzZ1", "en", "s", 1)], SCHEMA))
    for r in secrets.find_secrets(docs).collect():
        text, want = r.text or "", []
        want += [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 16]
        assert [(s.start, s.kind_no, s.end) for s in r.spans if s.base] == sorted(want), text
        if r.doc_id == 900:
            assert [text[s.start : s.end] for s in r.spans] == [noise]
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tail_of_the_normal_law(spark):
    got = spark.createDataFrame([(0.0,), (1.0,), (1.959964,), (-3.0,)], "z double").select(secrets.tail(F.col("z")).alias("p")).collect()
    assert np.allclose([r.p for r in got], [1.0, 0.317311, 0.05, 0.0026998], atol=1e-6)


def test_language(spark):
    words = {"en": "the of and is house water", "fr": "le la les est maison eau", "de": "der die das ist haus wasser"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[k].split(), 30)), k, "s", 1) for i in range(300) for k in [("en", "fr", "de")[i % 3]]]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fitted(docs)
    found = language.identify(docs.unionByName(documents(spark)), model).collect()
    right = [r.lang == r.lang_pred for r in found[:300] if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean(right) > 0.95
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (letters or not r.accepted)
    nothing = language.fitted(spark.createDataFrame([], SCHEMA))
    assert language.identify(spark.createDataFrame([], SCHEMA), nothing).count() == 0


def test_language_rejects_unlearned_languages_and_junk(spark):
    words = {"en": "the of and is house water", "fr": "le la les est maison eau", "de": "der die das ist haus wasser"}
    rng = np.random.default_rng(6)
    made = lambda k, n: " ".join(rng.choice(k.split(), n))
    rows = [(i, made(words[("en", "fr", "de")[(i + (i % 25 == 0)) % 3]], 30), ("en", "fr", "de")[i % 3], "s", 1) for i in range(900)]  # one in 25 mislabelled
    model = language.fitted(spark.createDataFrame(rows, SCHEMA))
    junk = lambda: " ".join("".join(rng.choice(list("bcdfgjkqvxz0123456789"), 9)) for _ in range(30))
    asked = {"unlearned": [made("kuuma joki talvi pimeys ruoka lumi", 30) for _ in range(100)], "junk": [junk() for _ in range(100)], "learned": [made(words[k], 30) for k in words for _ in range(40)]}
    share = {}
    for name, texts in asked.items():
        found = language.identify(spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], SCHEMA), model).collect()
        share[name] = np.mean([r.accepted for r in found])
    assert share["unlearned"] <= 0.1 and share["junk"] <= 0.1 and share["learned"] >= 0.9, share


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 12)).astype(np.float32)
    v[7] = v[8]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5100, [0.0] * 12), (5200, [float("nan")] * 12), (5300, [None] * 12)]
    df = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "embedding")
    assert df.count() == 1500
    books = neighbours.fit(df, "embedding")
    got = neighbours.search(neighbours.build_index(df, books, "embedding"), df.filter("vec_id % 100 = 0"), books, "vec_id", "embedding").collect()
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert np.allclose([r.score for r in mine], d[[r.vec_id for r in mine]], rtol=1e-12)
        hits += len({r.vec_id for r in mine} & set(np.lexsort((np.arange(1500), d))[:10].tolist()))
    assert hits / 150 >= 0.9


@pytest.mark.parametrize("dims", [5, 32])
def test_neighbours_of_a_full_chunk_with_a_hot_cluster(dims):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(neighbours.CHUNK, dims)).astype(np.float32).astype(float)
    ids = rng.permutation(len(v)) + 100
    v[:1400] = v[0]  # one hot vector
    v[1400:2800] = v[1400] + rng.normal(size=(1400, dims)) * 1e-3  # one dense cluster
    books = neighbours.Codebooks(v[rng.permutation(len(v))[:1000]])
    codes = books.pack(books.encode(v))
    asked = np.r_[0:1400:100, 1400:2800:100, 2800:4096:100]
    scan = neighbours.Scan(books, ids[asked], v[asked], 10)
    scan.add(ids, v, codes)
    got = scan.found().to_pandas()
    for a in asked:
        d = np.sqrt(((v - v[a]) ** 2).sum(1))
        d[a] = np.inf
        want = np.lexsort((ids, d))[:10]
        mine = got[got.query_id == ids[a]]
        assert mine.vec_id.tolist() == ids[want].tolist()
        assert mine.score.tolist() == d[want].tolist()


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    books = neighbours.fit(none, "embedding")
    assert neighbours.search(neighbours.build_index(none, books, "embedding"), none, books, "vec_id", "embedding").count() == 0


def test_neighbours_of_the_embeddings_as_brute_force(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {(r.query_id, r["rank"]): r for r in neighbours.op6_nearest(spark, folder).collect()}
    asked = np.flatnonzero(ids % 100 == 0)
    assert len(got) == 10 * len(asked)
    for i in asked:
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        d[i] = np.inf
        want = np.lexsort((ids, d))[:10]
        assert [got[ids[i], k + 1].vec_id for k in range(10)] == ids[want].tolist()
        assert [got[ids[i], k + 1].score for k in range(10)] == d[want].tolist()


def test_the_scan_excludes_most_rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 4
    v = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))
    books = neighbours.Codebooks(v[:2000])
    scan = neighbours.Scan(books, np.arange(20), v[:20], 10)
    for k in range(0, 6000, 500):  # small batches go through the scan as well
        scan.add(np.arange(k, k + 500), v[k : k + 500], books.pack(books.encode(v[k : k + 500])))
    assert scan.measured < 0.25 * 20 * 6000


def test_neighbours_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.5]), (None, [1.0, 0.1]), (3, [1.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (100, [1.0, 0.2]), (100, [1.0, 0.0])]
    df = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "embedding")
    assert df.count() == 6
    books = neighbours.fit(df, "embedding")
    index = neighbours.build_index(df.withColumn("CODE", F.lit(1)), books, "embedding")
    assert index.columns == ["vec_id", "embedding", "code"]
    got = neighbours.search(index, df.filter("vec_id = 100"), books, "vec_id", "embedding", block_bytes=1).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0.0), (4, 0.0), (4, 0.0), (2, 0.5)]


@pytest.mark.parametrize("text", ["mail a@b.c 1.2.3.\u00b2 x", "call 12345678 v10.0.0.\u00b2 ok", "see 555-123-456 and 1.2.3.\u00b2", "\u0663\u0663 at \u00b2 dot com", "+\u00b2 (1234567"])
def test_pii_of_other_digits(text):
    assert isinstance(pii.find_spans(text, pii.trained()), list)


def test_pii_of_long_runs_in_linear_time():
    weights = pii.trained()
    for text in ("7" * 1_000_000, "1." * 50_000, "a@" * 50_000, "at " * 50_000, "4111 1111 1111 1111 " * 5_000, "+1 (" * 50_000):
        started = time.process_time()
        pii.find_spans(text, weights)
        assert time.process_time() - started < 15, text[:10]


def test_pii_of_a_long_name():
    name = "a" * 44
    assert [s["kind"] for s in pii.find_spans(f"write to ana at {name} dot com today", pii.trained()) if not s["base"]] == ["email"]


def test_pii_recall_and_precision_on_unseen_sentences():
    rng, weights = random.Random(77), pii.trained()
    hits = found = wanted = 0
    for _ in range(600):
        text, spans = pii._example(rng)
        got = {(s["start"], s["end"], s["kind"]) for s in pii.find_spans(text, weights)}
        want = {(s, e, pii.KINDS[k]) for k, s, e in spans}
        hits, found, wanted = hits + len(got & want), found + len(got), wanted + len(want)
    assert hits / wanted > 0.9 and hits / found > 0.85, (hits / wanted, hits / found)


def test_pii_transitions_are_learned():
    weights = pii.trained()
    assert np.diag(weights[:, pii.BEFORE_KIND :]).min() > 0  # lists hold entities of one kind


def test_masking_stands_any_columns(spark):
    df = spark.createDataFrame([(1, "to bob@x.org now", "a"), (1, "to bob@x.org now", "a"), (None, None, None)], "doc_id long, text string, masked string")
    assert sorted(pii.mask_pii(df).collect(), key=str) == sorted([(1, "to [EMAIL] now", "a")] * 2 + [(None, None, None)], key=str)
    assert pii.mask_pii(df.limit(0)).count() == 0


def test_secrets_both_error_rates(spark):
    rng = random.Random(6)
    bag = "user account settings value index count handler request response session factory builder config default render update create delete parse format string buffer stream reader writer manager service client".split()
    alphabets = {"hex": "0123456789ABCDEF", "base32": secrets.ALPHABETS["base32"], "base36": secrets.ALPHABETS["base36"], "base64": secrets.ALPHABETS["base64"]}
    noise = {"".join(rng.choice(alphabets[k]) for _ in range(n)) for k in alphabets for n in (24, 32, 48, 64) for _ in range(40)}
    camel = {"".join(w.title() for w in rng.choices(bag, k=rng.randint(4, 7))) + rng.choice(("", "2", "V3", "Id")) for _ in range(600)}
    paths = {"/".join(rng.choices(bag, k=rng.randint(4, 7))) + f"/v{rng.randint(1, 9)}/{rng.choice(bag).title()}" for _ in range(600)}
    rows = [(i, f"see {t} here") for i, t in enumerate([*sorted(noise), *sorted(camel), *sorted(paths)])]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    said = {t for r in got for t in [r.text[s.start : s.end] for s in r.spans if not s.base]}
    assert len(said & noise) > 0.9 * len(noise), len(said & noise) / len(noise)
    assert len(said - noise) <= 0.05 * len(said), sorted(said - noise)[:10]


def test_secrets_of_many_matches_in_one_text(spark):
    text = " ".join(f"{i:016x}" for i in range(40_000))
    started = time.time()
    got = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), columns=["doc_id"]).first()
    assert [(s.start, s.end) for s in got.spans] == [(17 * i, 17 * i + 16) for i in range(40_000)]
    assert time.time() - started < 60


def test_secrets_stand_any_columns(spark):
    df = spark.createDataFrame([(1, "password=b7db7aa4a5fcc78305", 2, 3)], "doc_id long, text string, base int, Tokens int")
    got = secrets.find_secrets(df).first()
    assert (got.base, got.Tokens, [s.kind for s in got.spans]) == (2, 3, ["assign", "hex"])


def test_op5_as_the_contract_says(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = language.op5_language_id(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    learned = {d.lang for d in docs.values() if d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 3 != 1}
    right = []
    for r in got:
        text = docs[r.doc_id].text or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text))) and r.lang_pred in learned | {"und"}
        if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und":
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) > 0.95


def test_bounded_sample_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id")
    for rows in (1, 50, 2500, 5000):
        got = common.bounded_sample(df, ["id"], F.col("k"), rows)
        assert len(got) == min(rows, 3000)
    assert common.bounded_sample(df.limit(0), ["id"], F.col("k"), 5) == []
    plain = spark.range(1000)
    assert [r.id for r in common.bounded_sample(plain.repartition(7), ["id"], F.col("id"), 20)] == [r.id for r in common.bounded_sample(plain, ["id"], F.col("id"), 20)]
