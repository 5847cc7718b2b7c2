"""Conversation repair, line dedup and fill-in-the-middle against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quillspark.llm import infill, line_dedup, turns

from .fixtures import SCHEMA, documents, stable, texts

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
BLANK = " \t\n\x0b\x0c\r"
TALK = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit, repaired) over all edits, from the end: whole audits are compared."""
    fault = faults(rows)

    @lru_cache(None)
    def rest(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[after]

        def then(cost, letter, message, tail):
            found.extend((cost + c, letter + s, (*message, *m)) for c, s, m in tail)

        if inserted < 2:
            then(3, "I", [f"{name}:"], rest(i, after, inserted + 1))
        if i < len(rows):
            _, role, text = rows[i]
            then(4, "D", [], rest(i + 1, state, 0))
            if fault[i] not in ("blank", "duplicate"):
                more = 3 * (fault[i] == "truncated")
                then(3 + more, "R", [f"{name}:{text}"], rest(i + 1, after, 0))
                if role[:1] == after or (role[:1] == "s" and state == ""):
                    then(more, "K", [f"{role}:{text}"], rest(i + 1, role[:1], 0))
        return sorted(found)[:1]

    return rest(0, "", 0)[0]


def wanted(rows):
    """The digest of rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", sha(""))
    known, kinds = [t for t, _, _ in rows if t is not None], Counter(faults(rows))
    cost, audit, repaired = cheapest(rows)
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, sha("\n".join(repaired)))


def digest(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def talk(rng, n):
    text = lambda: rng.choice(["Yes.", "No!", "and so", "", " \t", "Why?", "Well. ", "x\x1d", "Yes.", None, f"T{rng.randint(0, 99)}."])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "user", "tool", "", "usher", None])
    return [(rng.choice([k, k, k, k + 1, None, 0]), role(), text()) for k in range(n)]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    made = {c: talk(rng, rng.randint(1, 9)) for c in range(400)}
    made[None] = talk(rng, 6)
    made[5000] = [(k, ("user", "assistant")[k % 2], f"Line {k}.") for k in range(3000)]  # a long one
    made[5001] = [(k, "system", "") for k in range(40)]
    return made


def test_summary_and_messages(spark, talks):
    rows = [(c, *m) for c, ms in talks.items() for m in ms]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, TALK).withColumns({"Fault": F.lit(1), "present": F.lit("x"), "conv": F.lit(2)})  # other columns don't matter
    names = ("conv_id", "turn", "role", "text")
    got = {r.conv_id: digest(r) for r in turns.repair_summary(df, *names).collect()}
    plain = {c: [(t, " " if r is None else r, " " if x is None else x) for t, r, x in ms] for c, ms in talks.items()}
    assert got.keys() == talks.keys()
    for c, ms in plain.items():
        if c == 5000:
            assert got[c][5:7] == (0, "K" * 3000)
        else:
            assert got[c] == wanted(ms), (c, ms)
    said = defaultdict(list)
    for r in sorted(turns.repaired_messages(df, *names).collect(), key=lambda r: r.step):
        said[r.conv_id].append(r)
    for c in plain:
        assert "".join(r.edit for r in said[c]) == got[c][6]
        assert sha("\n".join(f"{r.role}:{r.text}" for r in said[c] if r.edit != "D")) == got[c][7]
    assert turns.repair_summary(df.limit(0), *names).count() == 0 and turns.repaired_messages(df.limit(0), *names).count() == 0


def test_long_conversations_are_not_held(talks):
    """Edits come out while a conversation goes on, whatever is wrong in it."""
    rng = random.Random(6)
    parse, most, came = turns.Parse(), 0, 0
    for k in range(20000):
        role, fault = rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "", "truncated", "blank", "duplicate"])
        came += sum(e[0] != "I" for e in parse.add((k, role, "x"), fault))
        most = max(most, len(parse.open))
    came += sum(e[0] != "I" for e in parse.end())
    assert came == 20000 and most < 300


def test_op11(spark, tmp_path, talks):
    rows = [(c, *m) for c, ms in talks.items() for m in ms if c != 5000]
    rows += [(6000 + k, k, "user", "Only one.") for k in range(60)]  # some are dropped whole
    spark.createDataFrame(rows, TALK).write.parquet(str(tmp_path / "conversations.parquet"))
    want = defaultdict(list)
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[c] += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = {r.conv_id: digest(r) for r in turns.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: wanted(ms) for c, ms in want.items()} and any(not ms for ms in want.values())


LINES = ["a line that many of the documents here have, word for word", "  A Line that many of the documents here HAVE, word for word\t", "short", "", "é" * 39, "É" * 40]


@pytest.fixture
def lined(spark, tmp_path):
    rng = random.Random(9)
    pool = [f"boiler plate number {k} that goes on for more than forty characters" for k in range(12)] + LINES
    made = [(9000 + k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))), "en", "s", 1) for k in range(60)]
    made += [(9990, pool[0], "en", "s", 1)] * 3 + [(None, pool[1], "en", "s", 1), (None, pool[1] + "\n", None, None, None)]
    made.append((9991, "\n".join([pool[2]] * 4000 + ["end"]), "en", "s", 1))  # one long text, one line
    rows = documents(spark).unionByName(spark.createDataFrame(made, SCHEMA))
    return stable(spark, tmp_path, rows.withColumns({"N_Lines": F.lit(3), "gone": F.lit("mine"), "text_": F.col("text")}))


def without_repeats(rows, least=5):
    key = lambda line: line.strip(BLANK).translate({k: k + 32 for k in range(65, 91)})
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    last = {k: max(i for i in ids if i is not None) for k, ids in held.items() if len(ids) >= least}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if last.get(key(line), i) == i]
        yield i, len(lines), len(lines) - len(kept), "\n".join(kept)


def test_repeated_lines(spark, tmp_path, lined):
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    got = line_dedup.drop_repeated_lines(lined, "doc_id", "text")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone", "text_", "n_lines", "n_dropped", "kept_text"]
    want = Counter(without_repeats(rows))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want
    assert sum(n for *_, n, _ in want) > 100
    assert line_dedup.drop_repeated_lines(lined.limit(0), "doc_id", "text").count() == 0


def test_repeated_lines_by_shuffle(spark, lined, monkeypatch):
    from quillspark.llm import common

    monkeypatch.setattr(common, "SMALL_BYTES", -1)
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    got = line_dedup.drop_repeated_lines(lined, "doc_id", "text", min_docs=3).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == Counter(without_repeats(rows, 3))


def test_op12(spark, tmp_path, lined):
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    got = line_dedup.op12_line_dedup(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter((i, n, d, sha(k)) for i, n, d, k in without_repeats(rows))


KINDS = [infill.LINES, infill.opened_by("#"), infill.words(r"\x20\n"), infill.runs("a-z", "0-9"), infill.characters()]


@pytest.mark.parametrize("kind", KINDS, ids=lambda k: k.grammar)
def test_boundaries_are_those_of_the_grammar(spark, kind):
    rng = random.Random(2)
    odd = ["".join(rng.choice("ab #9\n😀é.") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [t or "" for t in texts()]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select("t", infill.units(F.col("t"), kind).alias("u")).collect()
    assert all(r.u == re.findall(kind.grammar, r.t) for r in got)


def test_op13(spark, tmp_path):
    marked = [(7000 + k, t, "en", "s", 1) for k, t in enumerate(["a <P> b\n", "<S>", "x<M", "<\nP>\n<", "\n", "\n\n\n", "a\nb\nc\nd\n" * 3000, "<P\n>"])]
    docs = stable(spark, tmp_path, documents(spark).unionByName(spark.createDataFrame(marked, SCHEMA)))
    rows, want, forms = docs.collect(), Counter(), Counter()
    for r in rows:
        text, hexed = r.text or "", sha(f"7:{'' if r.doc_id is None else r.doc_id}")
        u = re.findall(r"[^\n]*\n|[^\n]+", text)
        h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
        lo, hi = sorted(x % (len(u) + 1) for x in h[:2])
        pre, mid, suf = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
        form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) else "spm" if h[3] % 100 < 50 else "psm"
        output = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        sizes = (None, None) if form == "plain" else (len(pre), len(mid))
        want[(r.doc_id, len(u), form, *sizes, sha(output), sha(text))] += 1
        forms[form] += 1
    assert Counter(map(tuple, infill.op13_fill_in_middle(spark, str(tmp_path)).collect())) == want and len(forms) == 3
    own = docs.withColumns({"pieces": F.lit(1), "Form": F.lit("x"), "drawn": F.lit(None).cast("int")})
    kept = infill.fill_in_middle(own, "doc_id", "text", kind=infill.words(r"\x20"), markers=("[pre]", "[suf]", "[mid]"), rate=60)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "pieces", "drawn", "n", "form", "prefix", "middle", "suffix", "output"]
    back = kept.select("text", "form", infill.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back) and len({r.form for r in back}) == 3
    assert infill.fill_in_middle(own.limit(0), "doc_id", "text").count() == 0
    for bad in (("", "b", "c"), ("ab", "ba", "c"), ("a", "a", "c"), ("abc", "b", "x"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(own, "doc_id", "text", markers=bad)
