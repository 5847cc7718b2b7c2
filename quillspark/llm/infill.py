"""Fill-in-the-middle: texts cut at unit boundaries and put in another order, and back."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, spare

ANY = r"[\s\S]"


@dataclass(frozen=True)
class Units:
    """A grammar of units and the zero-width places between them.

    ``grammar`` says what a unit is, matched left to right. ``joints`` are pairs of character
    classes: a unit ends between two neighbouring characters if some pair has the first
    character in its first class and the second in its second.
    """

    grammar: str
    joints: tuple[tuple[str, str], ...]

    @property
    def boundary(self) -> str:
        """The joints as one regular expression that takes no character."""
        return "|".join(f"(?<={before})(?={after})" for before, after in self.joints)


def closed_by(end: str) -> Units:
    """Units that reach up to and with a character of a class; the last may lack it."""
    return Units(f"[^{end}]*[{end}]|[^{end}]+", ((f"[{end}]", ANY),))


def opened_by(start: str) -> Units:
    """Units that begin with a character of a class; what is before the first one is a unit."""
    return Units(f"[{start}][^{start}]*|[^{start}]+", ((ANY, f"[{start}]"),))


def words(blank: str) -> Units:
    """Words with the blanks after them; blanks at the beginning are a unit."""
    return Units(f"[^{blank}]+[{blank}]*|[{blank}]+", ((f"[{blank}]", f"[^{blank}]"),))


def runs(*classes: str) -> Units:
    """Longest runs of one class, of classes that share no character; all others are one class."""
    rest = "".join(classes)
    parts = [*(f"[{c}]" for c in classes), f"[^{rest}]"]
    return Units("|".join(f"{p}+" for p in parts), tuple((a, b) for a in parts for b in parts if a != b))


def characters() -> Units:
    return Units(ANY, ((ANY, ANY),))


LINES = closed_by(r"\n")


def units(text: Column, kind: Units) -> Column:
    """The units of a text, which joined give the text; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, kind.boundary, -1))


def _checked(markers: tuple[str, str, str]) -> None:
    """Markers must be found where they were put, whatever stands beside them."""
    for a, b in itertools.product(markers, repeat=2):
        if not a or (a != b and a in b) or any(a[i:] == b[: len(a) - i] for i in range(1, len(a))):
            raise ValueError(f"markers must neither be empty nor overlap: {a!r}, {b!r}")
    if len(set(markers)) < 3:
        raise ValueError("markers must differ")


def fill_in_middle(
    df: DataFrame, id_col: str, text_col: str, kind: Units = LINES, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"), seed: int = 7, rate: int = 100, spm_rate: int = 50
) -> DataFrame:
    """Adds n (units), form (plain, psm, spm), prefix, middle, suffix and output to each row.

    Cuts and form are drawn from sha256 of ``seed:id``, so they depend on nothing but the row's
    id, on any partitioning. ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of these with the suffix
    first. Texts that are empty or contain a marker stay plain (output is the text; prefix,
    middle and suffix are null). Null texts count as empty, a null id as the empty string;
    repeated rows are treated alike; texts of any length are cut whole; an empty table gives
    none. One pass without a shuffle. Columns of ``df`` that are named like an added one are
    dropped.
    """
    _checked(markers)
    pre, suf, mid = markers
    added = ("n", "form", "prefix", "middle", "suffix", "output")
    own = [c for c in df.columns if c.lower() not in added]
    text, pieces, lo, hi, drawn = (spare(c, [*df.columns, *added]) for c in ("text", "pieces", "lo", "hi", "drawn"))
    number = lambda k: F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long")
    rows = df.withColumns({text: F.coalesce(F.col(text_col), F.lit("")), drawn: F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)})
    rows = rows.select(*own, text, drawn, units(F.col(text), kind).alias(pieces))
    rows = rows.withColumn("n", F.size(pieces).cast("long"))
    cuts = [(number(k) % (F.col("n") + 1)).cast("int") for k in (0, 1)]
    plain = (F.col(text) == "") | F.greatest(*(F.instr(F.col(text), m) for m in markers)).__gt__(0) | (number(2) % 100 >= rate)
    form = F.when(plain, "plain").when(number(3) % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumns({lo: F.least(*cuts), hi: F.greatest(*cuts), "form": form})
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice(pieces, start, length), ""))
    rows = rows.select(
        *own, "n", "form", text,
        part(F.lit(1), F.col(lo)).alias("prefix"),
        part(F.col(lo) + 1, F.col(hi) - F.col(lo)).alias("middle"),
        part(F.col(hi) + 1, F.size(pieces) - F.col(hi)).alias("suffix"),
    )
    output = (
        F.when(F.col("form") == "plain", F.col(text))
        .when(F.col("form") == "psm", F.concat(F.lit(pre), "prefix", F.lit(suf), "suffix", F.lit(mid), "middle"))
        .otherwise(F.concat(F.lit(suf), "suffix", F.lit(pre), "prefix", F.lit(mid), "middle"))
    )
    return rows.withColumn("output", output).drop(text)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output of the form was made from."""
    _checked(markers)
    parts = F.split(output, "|".join(re.sub(r"(\W)", r"\\\1", m) for m in markers), -1)  # nothing, then three parts
    order = lambda *at: F.concat(*(F.get(parts, F.lit(k)) for k in at))
    return F.when(form == "psm", order(1, 3, 2)).when(form == "spm", order(2, 3, 1)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = {
    "op13_fill_in_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                   sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
            FROM documents
        ), d AS (
            SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                   ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
            FROM t
        ), c AS (
            SELECT doc_id, x, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi, u,
                   CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100
                        THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), p AS (
            SELECT doc_id, x, n, form, coalesce(array_to_string(u[1:lo], ''), '') AS pre,
                   coalesce(array_to_string(u[lo + 1:hi], ''), '') AS mid, coalesce(array_to_string(u[hi + 1:], ''), '') AS suf
            FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(x) AS restored_sha256
        FROM p"""
}
