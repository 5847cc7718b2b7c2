"""Personal data: exact base patterns, and a semi-Markov conditional random field.

The field scores whole spans: features look at a complete candidate segment (its
digits, groups, separators, check digit, the three words before it), and transitions at
the entity just before it, if at most LINKS tokens that join a list (a comma, "and")
lie between.  A dynamic program over segments of at most MAX_TOKENS tokens chooses
boundaries and types together.  It is trained here, by gradient ascent on the likelihood
of sentences from a seeded generator.  A span that the field adds needs log-odds of
MARGIN over being none.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_texts, spare

KINDS = ("email", "ip", "card", "phone")
SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("base", T.BooleanType()),
        ]
    )
)

# --- fixed values: the base patterns ------------------------------------------------
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match starts where its digits start
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _emails(text: str):
    """EMAIL.finditer, without trying the pattern at words that no @ follows: a match
    starts where the run of local-part characters before an @ starts."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and LOCAL(text[start - 1]):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            done = at = m.end()
        else:
            at += 1


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-").__contains__


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns: leftmost, not overlapping within a kind; a match
    that fails its kind's test is dropped without another try inside it."""
    found = []
    if "@" in text:
        found += [("email", *m.span()) for m in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return found


# ---- the field ------------------------------------------------------------------------
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
MAX_TOKENS = 16  # of a segment
REACH = 64  # half the characters in which the tokens ahead of an anchor are first looked for
MARGIN = 2.0  # log-odds that an added span needs over being no span
LINKS = 3  # joining tokens after which an entity no longer counts for the next one

# --- fixed values: words that announce a kind ------------------------------------------
LINK = {",", ";", "/", "&", "and", "or", "und", "et", "y", "oder", "ou"}
CUES = {
    "email": {"mail", "email", "e", "contact", "write", "courriel", "correo", "schreiben"},
    "ip": {"ip", "address", "host", "server", "adresse", "from"},
    "card": {"card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta", "pan"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "teléfono", "téléphone", "handy"},
}
AT, DOT = {"at", "@"}, {"dot", "."}
N_FEATURES = 30  # of which the last four are the kinds of the entity before
BEFORE_KIND = 26
DECIMAL = frozenset("0123456789").__contains__


def _is_word(w: str) -> bool:
    return not DECIMAL(w[0]) and w[0].isalnum()


def _features(kind: int, words: list[str], seg: str, before: list[str], left: str, right: str) -> list[int] | None:
    """Numbers of the features of a whole segment for a kind; None if it cannot be one."""
    digits = NOT_DIGIT.sub("", seg)
    groups = [w for w in words if DIGIT.match(w)]
    marks = {w for w in words if not w[0].isalnum()}
    f = [0]
    if kind == 0:
        low = [w.lower() for w in words]
        ats = [i for i, w in enumerate(low) if w in AT]
        if len(ats) != 1 or not 0 < ats[0] < len(low) - 3 or not any(w in DOT for w in low[ats[0] + 2 :]):
            return None
        if not _is_word(low[-1]) or not low[0][0].isalnum():
            return None
        f.append(1 if "@" in marks else 2)
        f.append(3 if any(w == "dot" for w in low) else 4)
        f.append(5 if marks <= {"@", ".", "-", "_", "+", "%", "(", ")", "[", "]"} else 6)
        f.append(7 if 2 <= len(low[-1]) <= 6 else 8)
        f.append(9 if " " in seg else 10)
        joins = [p.strip("()[]") in AT | DOT for p in seg.lower().split()]
        f.append(11 if any(not a and not b for a, b in zip(joins, joins[1:], strict=False)) else 12)  # two words side by side
    elif kind == 1:
        if len(groups) != 4 or len(words) != 7 or marks != {"."} or len(seg) != sum(map(len, words)):
            return None
        f.append(1 if all(len(g) <= 3 and int(g) <= 255 for g in groups) else 2)
        f.append(3 if left in ".-" or right in ".-" else 4)
        f.append(5 if all(g == "0" or g[0] != "0" for g in groups) else 6)
    else:
        if not 7 <= len(digits) <= 19 or any(map(_is_word, words)) or not marks <= set("()+-./"):
            return None
        if words[0] not in "(+" and not DECIMAL(words[0][0]) or not DECIMAL(words[-1][0]):
            return None
        sizes = [len(g) for g in groups]
        if kind == 2:
            if not 13 <= len(digits) <= 19 or not marks <= {"-"}:
                return None
            f.append(1 if luhn(digits) else 2)
            f.append(3 if len(groups) == 1 else 4 if sizes[:-1] == [4] * (len(sizes) - 1) else 5)
            f.append(6 if digits[0] in "3456" else 7)
        else:
            if len(digits) > 15:
                return None
            f.append(1 if words[0] == "+" else 2)
            f.append(3 if "(" in marks else 4)
            f.append(5 if len(groups) == 1 else 6 if 2 <= min(sizes[1:]) and max(sizes) <= 4 else 7)
            f.append(8 if len(digits) in (10, 11, 12) else 9)
            f.append(10 if "/" in marks else 11)
            f.append(12 if sizes[0] == 4 and len(groups) in (2, 3) and len(sizes) > 1 and sizes[1] == 2 else 13)
    f.append(20 if any(w in CUES[KINDS[kind]] for w in before) else 21)
    f.append(22 if left in "" or left.isspace() or left in "(:<[,;\"'" else 23)
    f.append(24 if right in "" or right.isspace() or right in ").:>],;!?\"'" else 25)
    return f


def _candidates(text: str, tokens: list[tuple[str, int, int]]):
    """All segments (first token, last token, kind, features) that can be an entity."""
    out = []
    words = [w for w, _, _ in tokens]
    lows = [w.lower() for w in words]
    digit = [DECIMAL(w[0]) for w in words]
    letter = [not d and w[0].isalnum() for w, d in zip(words, digit, strict=True)]
    last = len(tokens)
    # up to where the tokens from each one on lie side by side, on one line
    reach = [last] * last
    for j in range(last - 2, -1, -1):
        apart = tokens[j + 1][1] - tokens[j][2] > 1 or "\n" in text[tokens[j][2] : tokens[j + 1][1]]
        reach[j] = j + 1 if apart else reach[j + 1]
    for i, (w, start, _) in enumerate(tokens):
        if not (digit[i] or letter[i] or w in "(+"):
            continue
        digits, ats, at, dotted, letters = 0, 0, i, False, False
        for j in range(i, min(i + MAX_TOKENS, reach[i])):
            if digit[j]:
                digits += len(words[j])
            elif lows[j] in AT:
                ats, at = ats + 1, j
            dotted |= lows[j] in DOT and i < at < j - 1
            letters |= letter[j]
            if digits > 19 and not letters:
                break
            kinds = ([0] if dotted and ats == 1 and at < j - 2 and letter[j] else []) + ([1] if j == i + 6 and not letters else []) + ([2, 3] if digits >= 7 and not letters else [])
            end = tokens[j][2]
            for k in kinds:
                f = _features(k, words[i : j + 1], text[start:end], lows[max(0, i - 3) : i], text[start - 1 : start], text[end : end + 1])
                if f:
                    out.append((i, j, k, f))
    return out


def _tokens(text: str, lo: int = 0, hi: int | None = None) -> list[tuple[str, int, int]]:
    return [(m[0], *m.span()) for m in TOKEN.finditer(text, lo, len(text) if hi is None else hi)]


def _scores(candidates, weights: np.ndarray) -> list[float]:
    return [float(sum(weights[k, x] for x in f)) for _, _, k, f in candidates]


# States between tokens: 0, or 1 + 4 d + k where an entity of kind k has ended d joining tokens ago.
STATES = 1 + len(KINDS) * (LINKS + 1)


def _after(state: int, link: bool) -> int:
    """The state after a token outside of entities."""
    return state + len(KINDS) if state and link and state + len(KINDS) < STATES else 0


def _kind_of(state: int) -> int:
    return (state - 1) % len(KINDS) if state else -1


def decode_spans(text: str, weights: np.ndarray, lo: int, hi: int) -> list[tuple[str, int, int]]:
    """The best segmentation of a stretch of text: entity segments of at most
    MAX_TOKENS tokens, all other tokens outside."""
    tokens = _tokens(text, lo, hi)
    candidates = _candidates(text, tokens)
    steps = np.maximum(weights[:, BEFORE_KIND:].max(axis=1), 0).tolist()
    starting: dict[int, list] = {}
    for (i, j, k, _), s in zip(candidates, _scores(candidates, weights), strict=True):
        if s + steps[k] > MARGIN:
            starting.setdefault(i, []).append((s - MARGIN, j, k))
    if not starting:
        return []
    # best[p]: for each state in front of token p, its score and how it was reached
    best: list[dict[int, tuple]] = [{} for _ in range(len(tokens) + 1)]
    best[0][0] = (0.0, None)
    for p, (w, _, _) in enumerate(tokens):
        link = w.lower() in LINK
        for state, (score, _) in best[p].items():
            to = _after(state, link)
            if to not in best[p + 1] or score > best[p + 1][to][0]:
                best[p + 1][to] = (score, (p, state, None))
            for s, j, k in starting.get(p, ()):
                total = score + s + (float(weights[k, BEFORE_KIND + _kind_of(state)]) if state else 0.0)
                if 1 + k not in best[j + 1] or total > best[j + 1][1 + k][0]:
                    best[j + 1][1 + k] = (total, (p, state, k))
    found, p = [], len(tokens)
    state = min(best[p], key=lambda x: (-best[p][x][0], x))
    while p:
        at, before, k = best[p][state][1]
        if k is not None:
            found.append((KINDS[k], tokens[at][1], tokens[p - 1][2]))
        p, state = at, before
    return found[::-1]


# ---- training ----------------------------------------------------------------------------
def _example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence and its entities (kind, start, end); about half of the numbers in it
    are none: prices, dates, versions, identifiers."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 9)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = rng.choice("3456") + number(rng.choice((13, 14, 14, 14)))
        full = next(body + d for d in "0123456789" if luhn(body + d))
        return rng.choice((full, " ".join(full[i : i + 4] for i in range(0, len(full), 4)), "-".join(full[i : i + 4] for i in range(0, len(full), 4))))

    makers = [
        lambda: (0, f"{word()}{rng.choice(('', '.', '_'))}{number(rng.randint(0, 2))}{word()}@{word()}.{rng.choice(('com', 'org', 'de', 'example.com'))}"),
        lambda: (0, f"{word()} at {word()} dot {rng.choice(('com', 'org', 'net', 'fr'))}"),
        lambda: (1, ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        lambda: (2, card()),
        lambda: (3, f"+{rng.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}"),
        lambda: (3, rng.choice((f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"+{number(2)} {number(3)} {number(7)}", f"+{number(11)}"))),
        lambda: (None, f"{number(4)}-{number(2)}-{number(2)}"),
        lambda: (None, f"{number(2)}/{number(2)}/{number(4)}"),
        lambda: (None, number(rng.randint(3, 20))),
        lambda: (None, f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}"),
        lambda: (None, ".".join(number(rng.randint(1, 4)) for _ in range(rng.choice((3, 5, 6))))),
        lambda: (None, " ".join(number(rng.randint(1, 5)) for _ in range(rng.randint(2, 6)))),
        lambda: (None, ", ".join(number(rng.randint(1, 5)) for _ in range(rng.randint(2, 6)))),
        lambda: (None, f"{number(3)}-{number(1)}-{number(5)}-{number(2)}-{number(1)}"),
        lambda: (None, f"{word()} at {word()}. {word()}"),
        lambda: (None, f"look at the dot on {word()}"),
        lambda: (None, f"{number(3)}-{number(4)}"),
    ]
    text, spans = "", []
    if rng.random() < 0.25:  # a list of entities of one kind
        maker = rng.choice(makers[:6])
        for n in range(rng.randint(2, 4)):
            kind, value = maker()
            text += rng.choice((", ", " and ", "; ", " / ")) if n else f"{word()} "
            spans.append((kind, len(text), len(text) + len(value)))
            text += value
        return text + f" {word()}", spans
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(2, 5))) + " "
        kind, value = rng.choice(makers)()
        if kind is not None and rng.random() < 0.4:
            text += rng.choice(sorted(CUES[KINDS[kind]])) + rng.choice((" ", ": "))
        if kind is not None:
            spans.append((kind, len(text), len(text) + len(value)))
        text += value + rng.choice((" ", ". ", ", "))
    return text + word(), spans


@functools.lru_cache(1)
def trained(examples: int = 900, rounds: int = 4, rate: float = 0.3) -> np.ndarray:
    """Weights (kind x feature): stochastic gradient ascent on the conditional
    log-likelihood, with marginals of segments and of the states before them from a
    forward-backward pass."""
    rng = random.Random(11)
    data = []
    for _ in range(examples):
        text, spans = _example(rng)
        tokens = _tokens(text)
        candidates = _candidates(text, tokens)
        gold = {(s, e, k) for k, s, e in spans}
        right = [(tokens[i][1], tokens[j][2], k) in gold for i, j, k, _ in candidates]
        if candidates:
            data.append(([w.lower() in LINK for w, _, _ in tokens], candidates, right))
    weights = np.zeros((len(KINDS), N_FEATURES))
    kinds = np.array([_kind_of(x) for x in range(STATES)])
    steps = {link: np.array([_after(x, link) for x in range(STATES)]) for link in (False, True)}
    for turn in range(rounds):
        rng.shuffle(data)
        for links, candidates, right in data:
            n, s = len(links), _scores(candidates, weights)
            entering = np.concatenate([np.zeros((len(KINDS), 1)), weights[:, BEFORE_KIND + kinds[1:]]], axis=1)  # kind x state before
            forward, backward = np.full((n + 1, STATES), -np.inf), np.full((n + 1, STATES), -np.inf)
            forward[0, 0], backward[n] = 0.0, 0.0
            by_start: dict[int, list[int]] = {}
            for c, (i, _, _, _) in enumerate(candidates):
                by_start.setdefault(i, []).append(c)
            for p, link in enumerate(links):
                np.logaddexp.at(forward[p + 1], steps[link], forward[p])
                for c in by_start.get(p, ()):
                    _, j, k, _ = candidates[c]
                    forward[j + 1, 1 + k] = np.logaddexp(forward[j + 1, 1 + k], np.logaddexp.reduce(forward[p] + entering[k]) + s[c])
            for p in range(n - 1, -1, -1):
                backward[p] = backward[p + 1, steps[links[p]]]
                for c in by_start.get(p, ()):
                    _, j, k, _ = candidates[c]
                    backward[p] = np.logaddexp(backward[p], entering[k] + s[c] + backward[j + 1, 1 + k])
            step, total = rate / (1 + turn), backward[0, 0]
            gold_state = _gold_states(links, candidates, right)
            for c, (i, j, k, f) in enumerate(candidates):
                p = np.exp(forward[i] + entering[k] + s[c] + backward[j + 1, 1 + k] - total)  # by state before
                for x in f:
                    weights[k, x] += step * (right[c] - p.sum())
                for x in range(1, STATES):
                    weights[k, BEFORE_KIND + kinds[x]] += step * ((right[c] and gold_state[i] == x) - p[x])
    return weights


def _gold_states(links: list[bool], candidates, right: list[bool]) -> list[int]:
    """The state in front of each token in the labelled segmentation."""
    ends = {j: k for (_, j, k, _), ok in zip(candidates, right, strict=True) if ok}
    inside = {p for (i, j, _, _), ok in zip(candidates, right, strict=True) if ok for p in range(i, j)}
    states = [0]
    for p, link in enumerate(links):
        states.append(1 + ends[p] if p in ends else states[-1] if p in inside else _after(states[-1], link))
    return states


# ---- both together -------------------------------------------------------------------------
# what every segment holds: an at before a dot, or in one run of numbers and marks (with at
# most one character between two tokens) seven digits or four dotted numbers
ANCHOR = re.compile(r"@|(?<![^\W\d_])[aA][tT](?![^\W\d_])|[0-9](?:(?:[^\S\n]|(?![0-9])\d)?[0-9()+\-./])*")
DOTTED = re.compile(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
BEFORE = MAX_TOKENS + 2  # tokens ahead of an anchor that a segment with it looks at


def _back(text: str, at: int, floor: int) -> int:
    """Where the BEFORE tokens ahead of a position start, or more of them; ``floor`` at least."""
    size = 2 * REACH
    while True:
        lo = max(floor, at - size)
        while lo > floor and not text[lo - 1].isspace():
            lo -= 1
        if lo == floor or sum(1 for _ in TOKEN.finditer(text, lo, at)) >= BEFORE:
            return lo
        size = 2 * (at - lo)


def stretches(text: str) -> list[tuple[int, int]]:
    """Disjoint parts of a text, ending at tokens, that hold every segment that can be an
    entity with the tokens its features look at."""
    out: list[tuple[int, int]] = []
    for m in ANCHOR.finditer(text):
        word = m[0] == "@" or m[0][0] in "aA"
        if not word and sum(map(len, DIGITS.findall(m[0]))) < 7 and not DOTTED.search(m[0]):
            continue
        hi, dot = m.end(), False
        for n, t in enumerate(TOKEN.finditer(text, m.end())):
            if n == MAX_TOKENS + LINKS + 1:
                break
            hi = t.end()
            dot |= t[0].lower() in DOT
        if word and not dot:
            continue
        floor = out[-1][1] if out else 0
        lo = _back(text, m.start(), floor) if m.start() > floor else floor
        if out and lo <= floor:
            out[-1] = out[-1][0], max(hi, floor)
        else:
            out.append((lo, hi))
    return out


def find_spans(text: str, weights: np.ndarray) -> list[dict]:
    """Base spans, and those of the field that touch none of them."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    found = [(s, KINDS.index(k), e, True) for k, s, e in base]
    at, last = 0, -1  # base spans that start before a span's end, and how far they reach
    for lo, hi in stretches(text):
        for kind, s, e in decode_spans(text, weights, lo, hi):  # in ascending order
            while at < len(taken) and taken[at][0] < e:
                last = max(last, taken[at][1])
                at += 1
            if last <= s:
                found.append((s, KINDS.index(kind), e, False))
    return [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in sorted(found)]


def find_pii(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Adds the spans of personal data in each whole text: kind, start and end in code
    points (end exclusive), and whether a base pattern gave it; by start, then kind.

    Null and empty texts have none (an empty array). Very long texts are searched as a
    whole: the field only looks at stretches around anchors (see ANCHOR), outside of which
    no segment can be an entity. Repeated rows stay; an empty table gives none; other columns
    pass through; one named ``spans_col`` is replaced.
    """
    weights = trained()

    def make():
        return lambda texts: [[find_spans(t, weights) for t in texts.to_pylist()]]

    return map_texts(df, text_col, [T.StructField(spans_col, SPANS)], make)


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in brackets, as in [EMAIL]; of
    overlapping spans the whole stretch gives way to the first kind. Null stays null, texts
    without spans stay as they are; repeated rows stay; an empty table gives none; other
    columns pass through, whatever their names."""
    weights = trained()

    def masked(text: str) -> str:
        out, at = [], 0
        for s in find_spans(text, weights):
            if s["start"] >= at:
                out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    name = spare("masked", df.columns)
    made = map_texts(df, text_col, [T.StructField(name, T.StringType())], lambda: lambda texts: [[masked(t) for t in texts.to_pylist()]])
    whole = F.when(F.col(text_col).isNotNull(), F.col(name))
    return made.withColumn(text_col, whole).select(*df.columns)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_string(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    counts = [count_of(base, k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_string(base), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))
