"""Review of wrong answers and stored cases: filters, lookups, migrations, stages, samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def needs_review(answer: Column, correct: Column, memo: Column) -> Column:
    """Answered wrongly, or with a memo that isn't blank."""
    return ~answer.eqNullSafe(correct) | (F.trim(F.coalesce(memo, F.lit(""))) != "")


def same_subject(subject: Column, wanted: str) -> Column:
    """Equal to the wanted subject, or one of the two holds the other; blank subjects never."""
    own, key = F.trim(F.coalesce(subject, F.lit(""))), F.lit(wanted.strip())
    return (own != "") & (F.contains(own, key) | F.contains(key, own))


def show_or_self(hits: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """Each hit as the row to show of the same key, of several the first by all columns; a hit
    without one stands for itself. ``shown`` has the columns of ``hits``."""
    others = [c for c in hits.columns if c != key]
    pick = shown.groupBy(key).agg(F.min(F.struct(*others)).alias("__shown"))
    joined = hits.join(pick, key, "left")
    return joined.select(key, *[F.when(F.col("__shown").isNotNull(), F.col(f"__shown.{c}")).otherwise(F.col(c)).alias(c) for c in others])


def first_match(rows: DataFrame, number: str, ident: str, value: str, order: Sequence[Column]) -> DataFrame:
    """The first row in an order whose number or id is the value."""
    return rows.filter((F.col(number) == value) | (F.col(ident) == value)).orderBy(*order).limit(1)


def rename_to_number(rows: DataFrame, name: str, number: str) -> DataFrame:
    """Stored rows whose name is their number, and whether that changed them."""
    return rows.withColumn("migrated", ~F.col(name).eqNullSafe(F.col(number))).withColumn(name, F.col(number))


def update_rows(rows: DataFrame, changes: DataFrame, key: str, stamp: str, now: Column) -> DataFrame:
    """Rows with the changed columns of ``changes`` (one row a key); a row that a change touches
    is stamped."""
    columns = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__touched"))
    out = rows.join(renamed, key, "left")
    touched = F.coalesce("__touched", F.lit(False))
    values = {c: F.when(touched, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns} | {stamp: F.when(touched, now).otherwise(F.col(stamp))}
    return out.withColumns(values).select(*rows.columns)


def merge_daily(stored: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """Daily roll-ups (solved, correct, confidence) after new answers: sums of both by day."""
    def counts(a: Column, b: Column) -> Column:
        empty = F.create_map().cast("map<string,bigint>")
        return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))

    old = stored.select(*by, F.col("solved").alias("s"), F.col("correct").alias("c"), F.col("confidence").alias("m"))
    both = old.join(new, list(by), "full")
    return both.select(*by, (F.coalesce("s", F.lit(0)) + F.coalesce("solved", F.lit(0))).alias("solved"), (F.coalesce("c", F.lit(0)) + F.coalesce("correct", F.lit(0))).alias("correct"), counts(F.col("m"), F.col("confidence")).alias("confidence"))


def daily_with_confidence(answers: DataFrame, day: Column, correct: Column, confidence: Column, *by: str) -> DataFrame:
    """Answers, right ones and counts by confidence of each day: counted by confidence first, so
    a day's map is built from as many rows as there are levels."""
    level = answers.groupBy(*by, day.alias("day"), confidence.alias("level")).agg(F.count("*").alias("n"), F.count_if(correct).alias("right"))
    pairs = F.array_sort(F.collect_list(F.struct("level", "n")))
    return level.groupBy(*by, "day").agg(F.sum("n").alias("solved"), F.sum("right").alias("correct"), F.map_from_entries(pairs).alias("confidence"))


def remaining(now: Column, target: Column) -> Column:
    """Days, hours, minutes and seconds until a moment; zeros after it."""
    left = F.greatest(F.lit(0), F.unix_timestamp(target) - F.unix_timestamp(now))
    part = lambda unit, size: F.floor(left % size / unit).cast("long")
    return F.struct(F.floor(left / 86400).cast("long").alias("days"), part(3600, 86400).alias("hours"), part(60, 3600).alias("minutes"), part(1, 60).alias("seconds"))


def sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n rows, drawn at random by a seed: the same ones in every run, however the rows
    are partitioned, since each row's draw is the md5 of the seed and its columns as text."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in rows.columns)))
    return rows.withColumn("__draw", draw).orderBy("__draw", *rows.columns).limit(n).drop("__draw")


# --- fixed values: stages of a source file and where each may lead ---------------------------------
STAGES = ("raw", "normalized", "reviewed", "failed")
TRANSITIONS = (("raw", "normalized"), ("raw", "failed"), ("normalized", "reviewed"), ("normalized", "failed"), ("failed", "raw"))


def stage_violations(log: DataFrame, item: str, stage: str, at: str) -> DataFrame:
    """(item, before, after) for each step of an item that no transition allows; the first stage
    must be raw, and a repeated stage is no step."""
    before = F.lag(stage).over(Window.partitionBy(item).orderBy(at, stage))
    steps = log.select(item, F.coalesce(before, F.lit("")).alias("before"), F.col(stage).alias("after")).filter(F.col("before") != F.col("after"))
    allowed = F.concat_ws(">", "before", "after").isin(*[f"{a}>{b}" for a, b in (("", "raw"), *TRANSITIONS)])
    return steps.filter(~allowed)


# --- fixed values: keys of a summary block, in the forms in which they are written --------------------
BLOCK_KEYS = {
    "one_line_summary": ("one_line_summary", "one-line-summary", "summary", "한줄요약", "한 줄 요약", "요약"),
    "key_issue": ("key_issue", "key_issues", "issue", "key_issue_points", "핵심쟁점", "핵심 쟁점", "쟁점"),
    "ruling_point": ("ruling_point", "holding_point", "held", "reason", "결론", "판결결론", "판결 결론"),
    "exam_takeaway": ("exam_takeaway", "exam_points", "exam_takeaway_points", "포인트", "시험포인트", "시험 포인트"),
}
ECHOES = (
    "please help", "## step", "one_line_summary", "key_issue", "ruling_point", "exam_takeaway", "holding_summary", "[output", "outputformat", "summary_key", "evidence_key", "rule_applied",
)
_FORMS = {form: key for key, forms in BLOCK_KEYS.items() for form in forms}


def parse_block(text: str | None) -> dict[str, str] | None:
    """The values of a block of "- key: value" lines, where other lines go on with the value
    before them; None unless all four are there and none repeats the template."""
    found: dict[str, list[str]] = {}
    key = None
    for line in filter(None, map(str.strip, (text or "").splitlines())):
        head, colon, value = line.partition(":")
        named = _FORMS.get(head.replace("-", "").strip().lower()) if colon else None
        if named:
            key = named
            if value.strip():
                found[key] = [value.strip()]
        elif key:
            found.setdefault(key, []).append(line)
    values = {k: " ".join(v) for k, v in found.items()}
    bad = lambda v: len(v) < 2 or v.count(":") >= 3 or any(e in v.lower() for e in ECHOES)
    return None if set(values) != set(BLOCK_KEYS) or any(map(bad, values.values())) else values


@F.pandas_udf(T.StructType([T.StructField(k, T.StringType()) for k in BLOCK_KEYS]))
def parsed_block(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for t in texts:
        yield pd.DataFrame([parse_block(x) or dict.fromkeys(BLOCK_KEYS) for x in t], columns=list(BLOCK_KEYS))
