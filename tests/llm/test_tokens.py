import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, common, packing, token_files, tokens
from quillspark.llm import library as lib
from quillspark.llm.library import Known, Library

from .fixtures import SCHEMA, documents, texts

MULTI, JSON, WORDS = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def le(ids):
    return np.array(ids, "<u4").tobytes()


def test_encode_and_decode_as_the_library(spark, library):
    docs = documents(spark).withColumnRenamed("n_chars", "decoded")  # a clashing name
    got = tokens.decode_bpe(tokens.encode_bpe(docs, MULTI), MULTI)
    assert got.columns == ["doc_id", "text", "lang", "source", "ids", "decoded"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    empty = spark.createDataFrame([], SCHEMA)
    assert tokens.decode_bpe(tokens.encode_bpe(empty, MULTI), MULTI).count() == 0


def mixed_texts():
    rng = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", "\t", ".", ",", "é", "1", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "İ", "日本", "\u0301", "\x1c", "\x85", "\u180e", "\u00a0", "Σας", "ΣΑΣ", "\u2003"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return [*(t or "" for t in texts()), *made]


def test_long_rows_merge_as_the_library(library):
    rng = random.Random(5)
    merger = bpe.Merger.from_ranks(MULTI)
    cases = ["a" * 3000, "ab" * 2000, "é" * 1500, "abcabd" * 500, "日本語" * 400, "acgt" * 700, "".join(rng.choice("abcdefghijklmnop") for _ in range(9000)), *mixed_texts()]
    got = bpe.encode_texts(pa.array(cases), merger, bpe.split_pattern())
    for i, text in enumerate(cases):
        assert got.values[got.starts[i] : got.starts[i + 1]].tolist() == library.encode_ordinary(text), text[:80]
    back = merger.decode(got)
    assert all(back.values[back.starts[i] : back.starts[i + 1]].tobytes() == t.encode() for i, t in enumerate(cases))


@pytest.mark.parametrize("path", [JSON, WORDS])
def test_pieces_through_the_library_as_whole_texts(path):
    whole = Tokenizer.from_file(path)
    cases = mixed_texts()
    got = Library(path)(pa.array(cases))
    for i, text in enumerate(cases):
        assert got.values[got.starts[i] : got.starts[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("path", [JSON, WORDS])
@pytest.mark.parametrize("room", [200_000, 40])
def test_a_task_encodes_no_piece_that_it_knows(monkeypatch, path, room):
    monkeypatch.setattr(lib, "KNOWN", room)
    cases, known, seen = [*mixed_texts(), "w" * 500], (Known(), Known()), []
    made = Library(path)
    ids = made._ids
    made._ids = lambda texts: (seen.extend(texts), ids(texts))[1]
    want = Library(path)(pa.array(cases))
    for turn in range(3):
        for k in range(0, len(cases), 7):
            seen.clear()
            got, whole = made(pa.array(cases[k : k + 7]), known), want.take(np.arange(k, min(k + 7, len(cases))))
            assert got.values.tolist() == whole.values.tolist() and got.starts.tolist() == whole.starts.tolist()
            assert all(len(x.pieces) == len(x.ids.counts) and len(x.pieces) <= max(room, 400) for x in known)
            if turn and room > 40:
                assert all(len(t.encode()) > lib.KNOWN_BYTES for t in seen)
    assert got.values.dtype == want.values.dtype


@pytest.mark.parametrize("path", [JSON, WORDS])
def test_words_skip_the_pattern(path):
    made, whole = Library(path), Tokenizer.from_file(path)
    letters = [c for c in map(chr, range(0x250)) if re.match(bpe.LATIN, c)]
    words = [*letters, *(a + b for a, b in zip(letters, reversed(letters), strict=True)), "".join(letters), "Straße", "ÀÉÎ", "word", "WORD"]
    got = made.words(words)
    for i, w in enumerate(words):
        assert got.values[got.starts[i] : got.starts[i + 1]].tolist() == whole.encode(w if made.suffix else " " + w).ids, w
    assert made.plain is not None
    made.library = None
    assert made.words(words).values.tolist() == got.values.tolist()  # by the model alone


def test_pieces_that_come_again_stay_known(monkeypatch):
    monkeypatch.setattr(lib, "KNOWN", 10)
    known, seen = Known(), []

    def encode(new):
        seen.extend(new.to_pylist())
        return bpe.Ragged.of(np.array([len(p) for p in new.to_pylist()], np.uint32), np.ones(len(new), np.int64))

    for k in range(20):
        got = known(pa.array(["a", "bb", f"new {k}", "x" * 100]), encode)
        assert got.values.tolist() == [1, 2, len(f"new {k}"), 100] and len(known.pieces) <= 10
    assert seen.count("a") == seen.count("bb") == 1


def test_a_process_encodes_no_string_of_an_earlier_task():
    made, seen = Library(WORDS), []
    through = made._through
    made._through = lambda library, texts: (seen.extend(texts), through(library, texts))[1]
    lib.memory.cache_clear()
    want = made(pa.array(mixed_texts()))
    for task in range(2):
        seen.clear()
        got = made(pa.array(mixed_texts()), *lib.memory(WORDS))
        assert got.values.tolist() == want.values.tolist() and got.starts.tolist() == want.starts.tolist()
        assert seen if not task else all(len(t.encode()) > lib.KNOWN_BYTES for t in seen)
    lib.memory.cache_clear()


def test_slices_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(common, "STEP_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "", "x" * 30, "abcdef", "abcd", "a"])], names=["t"])
    parts = [b.column(0).to_pylist() for b in common.slices(batch, "t")]
    assert parts == [["abc", None, ""], ["x" * 30], ["abcdef", "abcd"], ["a"]]


def test_counts_as_the_library(spark):
    lib = Tokenizer.from_file(JSON)
    for r in tokens.count_tokens(documents(spark), JSON).collect():
        assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids), r.text
    known = tokens.single_tokens(bpe.Merger.from_json(JSON), bpe.split_pattern())
    assert " the" in known and len(known) > 40_000
    assert all(len(lib.encode(t, add_special_tokens=False).ids) == 1 for t in list(known)[:500])


def test_token_files_round_trip(spark, tmp_path):
    docs = documents(spark).filter("doc_id is not null")
    lib = Tokenizer.from_file(JSON)
    manifest = token_files.write_token_files(docs, JSON, 2, f"file:{tmp_path}/files")
    rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    want = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert [r.doc_id for r in rows] == [i for i, _ in want]
    start = 0
    for r, (_, text) in zip(rows, want, strict=True):
        ids = lib.encode(text, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids), le(ids))
        start += len(ids)
    some = token_files.read_token_files(manifest, docs=[5, 17]).collect()
    assert sorted(r.doc_id for r in some) == [5, 17]
    file = token_files.FrameReader(manifest.first()["file"])
    file.entries = file.entries.copy()
    file.entries["check"][0] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        file.read(0)
    empty = spark.createDataFrame([], SCHEMA)
    assert token_files.read_token_files(token_files.write_token_files(empty, JSON, 2, f"file:{tmp_path}/none")).count() == 0


def test_packing_covers_every_id_once(spark):
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    lib = Tokenizer.from_file(WORDS)
    want = {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, WORDS).collect():
        assert bytes(r.ids) == le(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for parts, total in [*((p, len(want[d])) for d, p in pieces.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total if total else at <= 2048
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


@pytest.mark.parametrize("parts", [1, 32, 200])
def test_padding_does_not_depend_on_the_partitioning(spark, parts):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 900)))) for i in range(1200)]
    made = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), WORDS)
    fill = made.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n").alias("ids"), F.count("*").alias("windows")).first()
    assert fill.ids == sum(len(t.split()) + 1 for _, t in rows)
    assert fill.ids / fill.windows > 0.97 * 2048


def test_differencing_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 513, 600).tolist()
    sets = packing.karmarkar_karp(sizes, 80)
    assert sorted(i for s in sets for i in s) == list(range(600))
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert max(sums) - min(sums) < 40
    assert packing.windows_of([2048, 2048, 1], 2048) and len(packing.windows_of([1500, 1500], 2048)) == 2
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
