"""The opN queries as a whole, against the libraries and plain loops over the same rows."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillspark.llm import exact_dedup, packing, pii, secrets, token_files, tokens

from .fixtures import documents, stable

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture
def docs(spark, tmp_path):
    found = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    return {r.doc_id: r.text or "" for r in stable(spark, tmp_path, found).collect()}


def test_op1(spark, tmp_path, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = tokens.op1_bpe_round_trip(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(docs[r.doc_id]))


def spans(text, kinds):
    found = [(m.start(), k, m.end()) for k, (name, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m)]
    return [f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(found)]


def check_spans(r, want, counts):
    assert r.base_sha256 == sha(",".join(want))
    said = r.spans.split(",") if r.spans else []
    assert set(want) <= set(said) and said == sorted(said, key=lambda s: int(s.split(":")[1]))
    for kind, n in counts.items():
        assert n == sum(s.startswith(kind + ":") for s in want)


def test_op3(spark, tmp_path, docs):
    kinds = [("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 12), ("access", secrets.ACCESS, lambda m: len(m[0]) >= 18), ("hex", secrets.HEX, lambda m: len(m[0]) >= 16)]
    for r in secrets.op3_secrets(spark, str(tmp_path)).collect():
        check_spans(r, spans(docs[r.doc_id], kinds), {"assign": r.n_assign, "access": r.n_access, "hex": r.n_hex})


def test_op4(spark, tmp_path, docs):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    for r in pii.op4_pii(spark, str(tmp_path)).collect():
        check_spans(r, spans(docs[r.doc_id], kinds), {"email": r.n_email, "ip": r.n_ip, "card": r.n_card, "phone": r.n_phone})


def test_op7(spark, tmp_path, docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {d: library.encode(t, add_special_tokens=False).ids + [1] for d, t in docs.items()}
    seen, windows = {d: 0 for d in docs}, {}
    for r in sorted(packing.op7_packing(spark, str(tmp_path)).collect(), key=lambda r: r.start):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])
        seen[r.doc_id] += r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {d: len(x) for d, x in want.items()}
    for parts in windows.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_op8(spark, tmp_path, docs):
    normal = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t) for d, t in docs.items()}
    for r in exact_dedup.op8_exact_dedup(spark, str(tmp_path)).collect():
        same = [d for d in docs if normal[d] == normal[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(same), len(same), r.doc_id == min(same), sha(normal[r.doc_id]))


def test_op9(spark, tmp_path, docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in tokens.op9_token_counts(spark, str(tmp_path)).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


def test_op10(spark, tmp_path, docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, got = 0, {r.doc_id: r for r in token_files.op10_token_files(spark, str(tmp_path)).collect()}
    for d in sorted(docs):
        ids = library.encode(docs[d], add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
