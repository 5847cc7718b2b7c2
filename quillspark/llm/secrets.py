"""Secret scans with DataFrame functions only.

Base patterns give exact spans. Other tokens that could hide a secret go through a
battery of randomness tests on the symbols of their inferred encoding: chi-squared
uniformity over the alphabet, runs about its middle, and serial correlation. Within each
class of lengths, false discoveries are controlled on both sides:

* "this token is random" is tested first; tokens for which the Benjamini-Hochberg rule
  rejects it are ordinary (of random ones, at most RATE are among them);
* "this token is ordinary" is tested for the others against a model of the tokens found
  ordinary (their changes between classes of symbols, and symbols within a class). The
  likelihood ratio of random to ordinary is an e-value: under the model it exceeds t with a
  chance of 1 / t at most. The Benjamini-Hochberg rule for e-values, which holds however
  tokens depend on each other, reports tokens of which at most FALSE are ordinary.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, spare, stored

KINDS = ("assign", "access", "hex", "random")

# --- fixed values: the base patterns ---------------------------------------------------
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

# A run of hex digits, or what follows AKIA, is matched as a whole or not at all, so
# asking for its least length in the pattern drops the same matches as a test afterwards.
ACCESS_LONG = r"AKIA[A-Z0-9]{14,}"
HEX_LONG = r"[0-9a-f]{16,}"

TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
RATE = 0.01  # of random tokens that may be taken for ordinary ones, by class of lengths
FALSE = 0.05  # of reported tokens that may be ordinary, by class of lengths
STAY = 0.85  # prior chance that a symbol of a name is of the class of the one before
BLOCK = 128  # matches whose places are summed up together
STEPS = 4  # bins of p-values for each unit of their natural logarithm
LAST_BIN = 160


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(numbers: Column, first: Column) -> Column:
    return F.aggregate(numbers, first, lambda a, v: a + v)


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it: first over blocks, then inside
    them, so that a long array costs little more than a short one per element."""

    def of_blocks(blocks: Column, sums: Column) -> Column:
        inside = lambda x, ahead: F.transform(x, lambda _, i: total(F.slice(x, F.lit(1), i), ahead))
        return F.flatten(F.transform(blocks, lambda x, b: let(total(F.slice(sums, F.lit(1), b), F.lit(0)), lambda ahead: inside(x, ahead))))

    starts = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK)))
    return let(blocks, lambda x: let(F.transform(x, lambda y: total(y, F.lit(0))), lambda sums: of_blocks(x, sums)))


def spans(text: Column, pattern: str, kind: str, least: int = 0, group: int = 0) -> Column:
    """Matches of a pattern as (start, kind_no, end, kind, value), in code points. Values
    are what ``group`` matched; shorter ones than ``least`` are dropped."""
    number = KINDS.index(kind)
    empty = F.expr("cast(array() as array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>)")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(
        whole.alias("found"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole).alias("values"),
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),  # what lies before, between and after the matches
    )

    def placed(p: Column) -> Column:
        sizes = F.transform(p["found"], F.length)
        steps = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["found"])), sizes, lambda g, m: g + m)
        rows = F.arrays_zip(sums_before(steps).alias("before"), p["gaps"].alias("gap"), sizes.alias("size"), p["values"].alias("value"))
        kept = F.filter(rows, lambda r: r["value"].isNotNull() & (F.length(r["value"]) >= least))
        return F.transform(
            kept,
            lambda r: F.struct(
                (r["before"] + r["gap"]).alias("start"),
                F.lit(number).alias("kind_no"),
                (r["before"] + r["gap"] + r["size"]).alias("end"),
                F.lit(kind).alias("kind"),
                r["value"].alias("value"),
            ),
        )

    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(empty)


def blanked(text: Column, pattern: str) -> Column:
    """The text with spaces in place of each match."""
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
    woven = F.zip_with(F.split(text, pattern, -1), matches, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(woven, "")).otherwise(text)


# ---- randomness tests ---------------------------------------------------------------------
# --- fixed values: alphabets of the encodings, in the order of their symbols' values ----
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
MIXED = {  # what a token of each encoding must look like, in the order they are tried
    "hex": r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$",
    "base32": r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$",
    "base36": r"^(?=[^0-9]*[0-9][^0-9]*[0-9])(?=.*[A-Za-z])([a-z0-9]+|[A-Z0-9]+)$",
    "base64": r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+=*$",
}


def encoding(token: Column) -> Column:
    """The narrowest encoding that a token fits; null for words, paths and rulers."""
    out = F
    for name, shape in MIXED.items():
        out = out.when(token.rlike(shape), F.lit(name))
    return out


def tail(z: Column) -> Column:
    """Two-sided tail of the normal law (rational approximation, error below 1e-7 of 1)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    # --- fixed values: coefficients of the approximation of erfc by Hastings ---
    poly = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + F.lit(c)) * t
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def randomness(token: Column) -> Column:
    """p-value of "the token is random": three tests on the values of its symbols, the
    smallest p times three. Null where no encoding fits."""
    name = encoding(token)
    body = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    body = F.when(name.isin("hex", "base36"), F.lower(body)).otherwise(body)
    alphabet = F
    for n, a in ALPHABETS.items():
        alphabet = alphabet.when(name == n, F.lit(a))
    k = F.length(alphabet).cast("double")

    def tests(s: Column) -> Column:
        x, k = s["x"], s["k"]
        n = F.size(x).cast("double")
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        mean = total / n
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)))
        chi = k / n * squares - n
        z_chi = (chi - (k - 1)) / F.sqrt(F.lit(2.0) * (k - 1) * (n - 1) / n)
        upper = F.size(F.filter(x, lambda v: v >= k / 2)).cast("double")
        lower = n - upper
        following = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = F.lit(1.0) + F.size(F.filter(following, lambda p: (p["a"] >= k / 2) != (p["b"] >= k / 2)))
        want = F.lit(2.0) * upper * lower / n + 1
        spread = F.greatest((want - 1) * (want - 2) / (n - 1), F.lit(1e-6))
        var = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        lag = F.aggregate(following, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        z_lag = F.when(var > 0, (lag / var + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        p_chi = F.when(z_chi > 0, tail(z_chi)).otherwise(F.lit(1.0))  # too even is no sign of a word
        return F.least(F.lit(1.0), F.lit(3.0) * F.least(p_chi, tail((runs - want) / F.sqrt(spread)), tail(z_lag)))

    values = F.transform(F.split(body, ""), lambda c: F.position(c, alphabet).cast("double"))
    input_ = F.struct(F.filter(values, lambda v: v > 0).alias("x"), k.alias("k"))
    one = F.transform(F.array(input_), tests)  # binds the symbols once
    return F.when(name.isNotNull(), F.get(one, F.lit(0)))


def find_secrets(df: DataFrame, text_col: str = "text", spans_col: str = "spans", rate: float = RATE, false: float = FALSE, columns: list[str] | None = None) -> DataFrame:
    """Adds the spans of secrets in each whole text: (start, kind_no, end, kind, base), by
    start and then kind; positions in code points, end exclusive.

    Null and empty texts have none (an empty array); repeated rows stay; an empty table gives
    none; other columns pass through whatever their names, one named ``spans_col`` is
    replaced. Tokens are what assignments leave, without those that hold another base span.
    The scan's spans, tokens and p-values are written once to the shared folder, since the
    decisions need all of them; ``columns`` names those to pass through, if not all are
    needed: what is not named isn't written.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(
        F.concat(
            spans(text, ASSIGN, "assign", LEAST["assign"], 2),
            spans(text, ACCESS_LONG, "access", LEAST["access"]),
            spans(text, HEX_LONG, "hex", LEAST["hex"]),
        )
    )
    rest = [c for c in (df.columns if columns is None else columns) if c.lower() != spans_col.lower()]
    base_col, token_col = spare("base", [*rest, spans_col]), spare("tokens", [*rest, spans_col])
    keep_base = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind_no"].alias("kind_no"), b["end"].alias("end"), b["kind"].alias("kind"), F.lit(True).alias("base")))
    free = F.filter(spans(blanked(text, ASSIGN), TOKEN, "random"), lambda t: ~t["value"].rlike(f"{ACCESS_LONG}|{HEX_LONG}"))
    tested = F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), randomness(t["value"]).alias("p")))
    binned = F.transform(
        F.filter(tested, lambda t: t["p"].isNotNull()),
        lambda t: F.struct(
            t["start"].alias("start"),
            t["end"].alias("end"),
            t["value"].alias("value"),
            F.floor(F.log2((t["end"] - t["start"]).cast("double")) * 2).cast("int").alias("lengths"),
            F.least(F.lit(LAST_BIN), F.ceil(-F.log(F.greatest(t["p"], F.lit(1e-30))) * STEPS)).cast("int").alias("bin"),
        ),
    )
    table = stored(df.select(*rest, keep_base.alias(base_col), binned.alias(token_col)))
    tokens = table.select(F.explode(token_col).alias("t")).select("t.lengths", "t.bin", "t.value")
    limits = ordinary_from(tokens.select("lengths", "bin"), rate)
    evidence = surprise(ordinary_model(tokens.filter(_rejected(F.struct("lengths", "bin"), limits)).select("value")))
    least = reported_from(tokens.filter(~_rejected(F.struct("lengths", "bin"), limits)).select("lengths", evidence(F.col("value")).alias("nats")), false)
    chosen = F.filter(token_col, lambda t: ~_rejected(t, limits) & _reported(t, evidence, least))
    added = F.transform(chosen, lambda t: F.struct(t["start"], F.lit(KINDS.index("random")).alias("kind_no"), t["end"], F.lit("random").alias("kind"), F.lit(False).alias("base")))
    return table.select(*rest, F.array_sort(F.concat(base_col, added)).alias(spans_col))


# ---- ordinary tokens ------------------------------------------------------------------------
def symbol_class(c: Column) -> Column:
    """0 lower case, 1 upper case, 2 digit, 3 mark."""
    return F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)


def ordinary_model(values: DataFrame) -> tuple[dict[tuple[int, int], float], dict[str, float]]:
    """Probabilities of the class that follows a class, and of a symbol within its class, from
    all tokens found ordinary; with few of them, what is usual in names counts for more. The
    counts are a table of pairs of classes and symbols, whatever the input."""
    symbols = values.select(F.posexplode(F.split("value", "")).alias("at", "symbol"), "value")
    pairs = symbols.filter("at > 0").select(symbol_class(F.substring("value", F.col("at"), F.lit(1))).alias("before"), symbol_class(F.col("symbol")).alias("after"), "symbol")
    counted = [(r["before"], r["after"], r["symbol"], r["n"]) for r in pairs.groupBy("before", "after", "symbol").agg(F.count("*").alias("n")).collect()]
    # --- fixed values: prior weights, letters by their frequency in English ---
    follow = {(a, b): 100.0 * (STAY if a == b else (1 - STAY) / 3) for a in range(4) for b in range(4)}
    within = {c: 2.0 * (26 - i) for i, c in enumerate("etaoinshrdlcumwfgypbvkjxqz")}
    within |= {c.upper(): n for c, n in within.items()} | dict.fromkeys("0123456789", 10.0) | dict.fromkeys("+/_-=", 10.0)
    for before, after, symbol, n in counted:
        follow[before, after] += n
        if symbol in within:
            within[symbol] += n
    kind = {c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in within}
    rows = [sum(follow[a, b] for b in range(4)) for a in range(4)]
    sums = [sum(n for c, n in within.items() if kind[c] == k) for k in range(4)]
    return {p: n / rows[p[0]] for p, n in follow.items()}, {c: n / sums[kind[c]] for c, n in within.items()}


def surprise(model: tuple[dict[tuple[int, int], float], dict[str, float]]) -> Callable[[Column], Column]:
    """Of a token, the logarithm of the likelihood ratio of random (all symbols of its encoding
    alike) to ordinary, from its second symbol on."""
    follow, within = model
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    table = F.create_map(*(x for a in "aA0+" for c, p in within.items() for x in (F.lit(a + c), F.lit(math.log(follow[kind(a), kind(c)] * p)))))
    stand_in = lambda c: F.element_at(F.array(*map(F.lit, "aA0+")), symbol_class(c) + 1)

    def of(value: Column) -> Column:
        name = encoding(value)
        size = F
        for n, a in ALPHABETS.items():
            size = size.when(name == n, F.lit(math.log(len(a))))
        chars = F.split(value, "")
        pairs = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.concat(stand_in(a), b))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc - size - F.coalesce(F.element_at(table, p), F.lit(0.0)))

    return of


def reported_from(tokens: DataFrame, false: float) -> dict[int, float]:
    """For each class of lengths, the evidence from which on tokens are reported: the least e
    with  tokens <= false * e * tokens as strong.  The counts are a table of classes and bins."""
    bins = F.least(F.lit(LAST_BIN), F.greatest(F.lit(0), F.floor(F.col("nats") * STEPS))).cast("int")
    counts = tokens.select("lengths", bins.alias("bin")).groupBy("lengths", "bin").count()
    whole = Window.partitionBy("lengths")
    strong = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"all": F.sum("count").over(whole), "strong": F.sum("count").over(strong)})
    enough = ranked.filter(F.col("all") <= F.col("strong") * F.exp(F.col("bin") / F.lit(float(STEPS))) * false)
    return {r["lengths"]: r["first"] / STEPS for r in enough.groupBy("lengths").agg(F.min("bin").alias("first")).collect()}


def _reported(token: Column, evidence: Callable[[Column], Column], least: dict[int, float]) -> Column:
    bound = F
    for lengths, nats in sorted(least.items()):
        bound = bound.when(token["lengths"] == lengths, F.lit(nats))
    return F.coalesce(evidence(token["value"]) >= bound, F.lit(False)) if least else F.lit(False)


def _rejected(token: Column, limits: dict[int, int]) -> Column:
    """Whether the rule takes a token for an ordinary one."""
    out = F.lit(False)
    for lengths, first in sorted(limits.items()):
        out = out | ((token["lengths"] == lengths) & (token["bin"] >= first))
    return out


def ordinary_from(tokens: DataFrame, rate: float) -> dict[int, int]:
    """For each class of lengths, the bin of p-values from which on tokens are ordinary:
    the rule's largest p with  tokens * p <= rate * tokens as small.  The counts are a
    table of classes and bins, a few thousand numbers whatever the input."""
    counts = tokens.groupBy("lengths", "bin").count()
    whole = Window.partitionBy("lengths")
    small = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    p = F.exp(-(F.col("bin") - 1) / F.lit(float(STEPS)))  # the largest p of the bin
    ranked = counts.withColumns({"all": F.sum("count").over(whole), "small": F.sum("count").over(small)})
    found = ranked.filter((F.col("bin") > 0) & (F.col("all") * p <= F.col("small") * rate)).groupBy("lengths").agg(F.min("bin").alias("first"))
    return {r["lengths"]: r["first"] for r in found.collect()}


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_string(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"), columns=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    counts = [count_of(base, k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(span_string(base), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))
