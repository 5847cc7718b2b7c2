"""Repair of conversations: an error-correcting Earley parse of the roles.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. The grammar below
says so, with productions for a message that goes, one that gets another role and one that is
missing. It is left-linear in the helper symbols (System, User, Assistant, Gone), so a chart
column needs nothing but the column before it, and completed items from the beginning of the
conversation carry all that is known: for each symbol the least (cost, audit).
"""

from __future__ import annotations

import hashlib
import heapq
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .line_dedup import BLANKS

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
TRUNCATED = 3  # what a truncated message costs that isn't deleted

# name, symbols, cost, letter of the audit. Symbols in lower case are read from the messages: an
# initial, a message that may stay ("message") and any message ("any").
RULES: list[tuple[str, tuple[str, ...], int, str]] = [
    ("Conversation", ("Empty",), 0, ""),
    ("Conversation", ("Answered",), 0, ""),
    ("Empty", (), 0, ""),
    ("Empty", ("Empty", "Gone"), 0, ""),
    ("Opened", ("Empty", "System"), 0, ""),
    ("Opened", ("Opened", "Gone"), 0, ""),
    ("Asked", ("Empty", "User"), 0, ""),
    ("Asked", ("Opened", "User"), 0, ""),
    ("Asked", ("Answered", "User"), 0, ""),
    ("Asked", ("Asked", "Gone"), 0, ""),
    ("Answered", ("Asked", "Assistant"), 0, ""),
    ("Answered", ("Answered", "Gone"), 0, ""),
    ("System", ("s",), 0, KEEP),
    ("User", ("u",), 0, KEEP),
    ("User", ("message",), 3, REROLE),
    ("User", (), 3, INSERT),
    ("Assistant", ("a",), 0, KEEP),
    ("Assistant", ("message",), 3, REROLE),
    ("Assistant", (), 3, INSERT),
    ("Gone", ("any",), 4, DELETE),
]
BY_NAME: dict[str, list[int]] = {}
for _k, _rule in enumerate(RULES):
    BY_NAME.setdefault(_rule[0], []).append(_k)
SPINE = ("Conversation", "Empty", "Opened", "Asked", "Answered")  # symbols that begin with the conversation
FIRST, BEFORE, HERE = 0, 1, 2  # where an item began: with the conversation, one column before, in this column
GONE_COST = 4

Value = tuple[int, str]  # cost, audit
State = tuple[tuple[str, int, str], ...]  # completed symbols of the spine with cost and audit, from the least
Token = tuple[str, str]  # initial of the role, fault


def _column(state: State | None, token: Token | None) -> dict[str, Value]:
    """The next chart column: least (cost, audit) of each symbol of the spine completed in it.

    ``state`` are these of the column before (none: the first column). Items are (rule, dot, where
    it began); the agenda is taken by (cost, audit), and an item that is found for less is
    taken again.
    """
    chart: dict[tuple[int, int, int], Value] = {}
    agenda: list[tuple[int, str, tuple[int, int, int]]] = []

    def put(item: tuple[int, int, int], cost: int, audit: str) -> None:
        if item not in chart or (cost, audit) < chart[item]:
            chart[item] = (cost, audit)
            heapq.heappush(agenda, (cost, audit, item))

    waiting: dict[str, list[tuple[int, int, int, int, str]]] = {}  # of the column before, by the symbol that they wait for
    if state is None:
        for k in BY_NAME["Conversation"]:
            put((k, 0, FIRST), 0, "")
    else:
        values = {name: (cost, audit) for name, cost, audit in state}
        for k, (_, symbols, _, _) in enumerate(RULES):
            if len(symbols) == 2 and symbols[0] in values:
                waiting.setdefault(symbols[1], []).append((k, 1, FIRST, *values[symbols[0]]))
        initial, fault = token
        offered = {"any"} if fault in ("blank", "duplicate") else {initial, "message", "any"}
        for helper in waiting:
            for k in BY_NAME[helper]:  # predicted in the column before; the scan
                _, symbols, cost, letter = RULES[k]
                if symbols and symbols[0] in offered:
                    put((k, 1, BEFORE), cost + (TRUNCATED if fault == "truncated" and symbols[0] != "any" else 0), letter)
    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if chart[item] != (cost, audit):
            continue
        k, dot, began = item
        name, symbols, _, _ = RULES[k]
        if dot < len(symbols):  # predict, and pass what is completed here already
            for r in BY_NAME.get(symbols[dot], []):
                here = FIRST if symbols[dot] in SPINE else HERE
                if here == FIRST and state is not None:
                    continue  # nothing of the spine begins in a later column
                put((r, 0, here), *((0, "") if RULES[r][1] else RULES[r][2:]))
                done = chart.get((r, len(RULES[r][1]), here))
                if done is not None:
                    put((k, dot + 1, began), cost + done[0], audit + done[1])
        elif began == FIRST:  # complete: rules that begin with this symbol
            for r, (_, parts, _, _) in enumerate(RULES):
                if parts and parts[0] == name:
                    put((r, 1, FIRST), cost, audit)
        elif began == BEFORE:
            for r, at, start, before, letters in waiting.get(name, []):
                put((r, at + 1, start), before + cost, letters + audit)
        else:
            for (r, at, start), (before, letters) in list(chart.items()):
                if at < len(RULES[r][1]) and RULES[r][1][at] == name:
                    put((r, at + 1, start), before + cost, letters + audit)
    found: dict[str, Value] = {}
    for (k, dot, began), value in chart.items():
        name, symbols, _, _ = RULES[k]
        if began == FIRST and dot == len(symbols) and (name not in found or value < found[name]):
            found[name] = value
    return found


@lru_cache(maxsize=1 << 15)
def _step(state: State | None, token: Token | None) -> tuple[State, str, int]:
    """The state after a message, the edits that are settled by now, and the cost taken out of the state.

    What goes on from any symbol can go on from Answered too, where at most one kept message
    (a system one) must be deleted; so a symbol dearer than Answered by more than a deletion
    leads to nothing. Letters with which all audits begin are settled: audits over the same
    messages and of equal cost differ before either ends, so a common beginning decides nothing.
    """
    found = {name: value for name, value in _column(state, token).items() if name != "Conversation"}
    if "Answered" in found:
        found = {name: value for name, value in found.items() if value[0] <= found["Answered"][0] + GONE_COST}
    settled = commonprefix([audit for _, audit in found.values()])
    least = min(cost for cost, _ in found.values())
    return tuple(sorted((name, cost - least, audit[len(settled) :]) for name, (cost, audit) in found.items())), settled, least


def _end(state: State) -> Value:
    """The least (cost, audit) of a whole conversation that ends in a state."""
    ends = {RULES[k][1][0] for k in BY_NAME["Conversation"]}
    return min((cost, audit) for name, cost, audit in state if name in ends)


class Parse:
    """One conversation, message after message. Edits come out as soon as they are settled, so
    what is held doesn't grow with the conversation but with what is still open in it."""

    def __init__(self) -> None:
        self.state, settled, self.cost = _step(None, None)
        self.open: deque[tuple] = deque()
        self.last = ""

    def add(self, message: tuple, fault: str | None) -> Iterator[tuple]:
        """``message`` is (turn, role, text). Yields (edit, turn, role, text, cost of edit's letter is not given)."""
        role = message[1]
        self.open.append(message)
        self.state, settled, cost = _step(self.state, (role[:1], fault or ""))
        self.cost += cost
        return self._edits(settled)

    def end(self) -> Iterator[tuple]:
        cost, rest = _end(self.state)
        self.cost += cost
        return self._edits(rest)

    def _edits(self, letters: str) -> Iterator[tuple]:
        for letter in letters:
            turn, role, text = (None, None, "") if letter == INSERT else self.open.popleft()
            if letter in (INSERT, REROLE):
                role = "assistant" if self.last == "u" else "user"
            if letter != DELETE:
                self.last = role[:1]
            yield letter, turn, role, text


def _in_order(df: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """(conv, turn, role, text, fault, present), each conversation in one partition and in order."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    ).repartition("conv")
    from pyspark.sql import Window

    alike = Window.partitionBy("conv").orderBy("present", "role", "text", "turn")
    again = (F.lag("present").over(alike) == F.col("present")) & (F.lag("role").over(alike) == F.col("role")) & (F.lag("text").over(alike) == F.col("text"))
    closed = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    fault = F.when(closed == "", "blank").when(again, "duplicate").when(~closed.isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault).sortWithinPartitions("conv", "turn", "role", "text")


def _streamed(ordered: DataFrame, schema: T.StructType, make: Callable[[], Callable[..., Iterator[tuple]]]) -> DataFrame:
    """Runs ``make()(conversation, message or None at its end)`` over the rows in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, now, begun = make(), None, False
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for conv, *message in zip(*columns, strict=True):
                if begun and conv != now:
                    out += take(now, None)
                now, begun = conv, True
                out += take(now, message)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if begun:
            out = list(take(now, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return ordered.select("conv", "turn", "role", "text", "present", "fault").mapInArrow(run, schema)


def repaired_messages(df: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None = None) -> DataFrame:
    """The cheapest repair of each conversation, edit by edit: (conv, step, edit, turn, role, text). Rows whose
    edit isn't D, by step, are the repaired conversation; inserted messages have an empty
    text and no turn.

    A conversation's messages are taken by turn, nulls first, equal turns by role and text.
    Null roles and texts count as one space, a null conversation is one conversation. A role
    that doesn't begin with s, u or a (an empty one too) can't be kept. The first of these
    is a message's fault: blank (nothing but ASCII white space), duplicate (role and text as in an earlier
    message), truncated (the last other character is none of ``.!?``). Kept messages cost 0,
    messages whose role is changed 3, deleted ones 4, inserted ones 3, truncated ones that stay 3
    more; blank and duplicate ones are deleted. Of the cheapest repairs the one
    whose edits (K, R, D, I) come first in ASCII is taken. Messages for which ``present`` isn't
    true take no part. Other columns are dropped; an empty table gives none.

    One shuffle, by conversation. A conversation streams through one task in order and is
    never held: of the chart one column, of the messages those whose edit is still open.
    """
    schema = T.StructType(
        [T.StructField(conv, df.schema[conv].dataType)]
        + [T.StructField(n, t) for n, t in (("step", T.LongType()), ("edit", T.StringType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()))]
    )

    def make() -> Callable[..., Iterator[tuple]]:
        parse, step = Parse(), 0

        def take(now, message) -> Iterator[tuple]:
            nonlocal parse, step
            if message is not None and not message[3]:
                return
            for edit in parse.end() if message is None else parse.add(tuple(message[:3]), message[4]):
                yield (now, step, *edit)
                step += 1
            if message is None:
                parse, step = Parse(), 0

        return take

    return _streamed(_in_order(df, conv, turn, role, text, present), schema, make)


def repair_summary(df: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None = None) -> DataFrame:
    """One row for each conversation that has a row, present or not: its id, gaps in its turns, the number of
    blank, duplicate and truncated messages and of illegal neighbours (initials other
    than su, ua, au), the cost and audit of the repair of ``repaired_messages``, and the sha256 of
    the repaired ``role:text``, joined by newlines. All else as there; without messages
    numbers are 0, audit and what is hashed empty. Turns that are null don't count as gaps."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType(
        [T.StructField(conv, df.schema[conv].dataType)] + [T.StructField(c, T.LongType()) for c in counts] + [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]
    )

    def make() -> Callable[..., Iterator[tuple]]:
        def fresh() -> dict:
            return {"parse": Parse(), "faults": dict.fromkeys(("blank", "duplicate", "truncated"), 0), "turns": [None, None, 0], "illegal": 0, "before": None, "audit": [], "digest": hashlib.sha256(), "any": False}

        c = fresh()

        def write(edits: Iterator[tuple]) -> None:
            for letter, _, role, text in edits:
                c["audit"].append(letter)
                if letter != DELETE:
                    c["digest"].update(f"{chr(10) if c['any'] else ''}{role}:{text}".encode())
                    c["any"] = True

        def take(now, message) -> Iterator[tuple]:
            nonlocal c
            if message is None:
                write(c["parse"].end())
                first, last, distinct = c["turns"]
                gaps = 0 if first is None else last - first + 1 - distinct
                yield (now, gaps, *c["faults"].values(), c["illegal"], c["parse"].cost, "".join(c["audit"]), c["digest"].hexdigest())
                c = fresh()
                return
            turn, role, text, there, fault = message
            if not there:
                return
            if fault:
                c["faults"][fault] += 1
            if turn is not None and turn != c["turns"][1]:  # in order
                c["turns"] = [turn if c["turns"][0] is None else c["turns"][0], turn, c["turns"][2] + 1]
            if c["before"] is not None and c["before"] + role[:1] not in ("su", "ua", "au"):
                c["illegal"] += 1
            c["before"] = role[:1]
            write(c["parse"].add((turn, role, text), fault))

        return take

    return _streamed(_in_order(df, conv, turn, role, text, present), schema, make)


def damaged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, present): messages with planted faults, by crc32 of ``conv:turn`` modulo 20: 0 drops a message
    (present is false), 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it the user's. Nulls count as one
    space, but null ids and turns are returned as they are."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space(conv), space(turn))) % 20
    texts = F.when(kind == 1, "").when(kind == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    made = df.select(
        F.col(conv), F.col(turn), F.when(kind == 4, "user").otherwise(space(role)).alias(role), texts.alias(text),
        (kind != 0).alias("present"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return made.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("conv_id", "turn", "role", "text")
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*names), *names)
    return repair_summary(rows, *names, present=F.col("present"))


# crc32 byte by byte, then the least (cost, audit) row after row: e, o, q, a are Empty, Opened, Asked, Answered.
ORACLE = {
    "op11_conversation_repair": r"""
        WITH RECURSIVE polynomial AS (
            SELECT list(c ORDER BY i) AS t FROM (
                WITH RECURSIVE bit AS (
                    SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i)
                    UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8
                ) SELECT i, c FROM bit WHERE k = 8)
        ), keyed AS (
            SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
        ), crc AS (
            SELECT k, 1 AS i, 4294967295::BIGINT AS c FROM keyed
            UNION ALL
            SELECT k, i + 1, xor(c >> 8, t[(xor(c, ascii(k[i])) & 255) + 1]) FROM crc, polynomial WHERE i <= length(k)
        ), kinds AS (
            SELECT k, xor(c, 4294967295) % 20 AS kind FROM crc WHERE i = length(k) + 1
        ), hurt AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
                   unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM conversations JOIN kinds ON k = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')
        ), m AS (
            SELECT coalesce(conv_id::VARCHAR, 'none') AS conv, turn, role, text, left(role, 1) AS ini,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                   right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS closed
            FROM hurt
        ), f AS (
            SELECT *, CASE WHEN closed = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN closed NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                   lag(ini) OVER (PARTITION BY conv ORDER BY n) AS before
            FROM m
        ), parse AS (
            SELECT DISTINCT conv, 0::BIGINT AS n, {'c': 0::BIGINT, 's': ''} AS e, {'c': NULL::BIGINT, 's': NULL::VARCHAR} AS o,
                   {'c': 3::BIGINT, 's': 'I'} AS q, {'c': 6::BIGINT, 's': 'II'} AS a FROM f
            UNION ALL
            SELECT conv, n, e, o, q, list_min([a, {'c': q.c + 3, 's': q.s || 'I'}]) FROM (
                SELECT conv, n, e, o, a, list_min([q, {'c': e.c + 3, 's': e.s || 'I'}, {'c': o.c + 3, 's': o.s || 'I'}, {'c': a.c + 3, 's': a.s || 'I'}]) AS q FROM (
                    SELECT conv, n, {'c': e.c + 4, 's': e.s || 'D'} AS e,
                           list_min([{'c': o.c + 4, 's': o.s || 'D'}, CASE WHEN stays AND ini = 's' THEN {'c': e.c + more, 's': e.s || 'K'} END]) AS o,
                           list_min([{'c': q.c + 4, 's': q.s || 'D'}, CASE WHEN stays AND ini = 'u' THEN {'c': p.c + more, 's': p.s || 'K'} END,
                                     CASE WHEN stays THEN {'c': p.c + 3 + more, 's': p.s || 'R'} END]) AS q,
                           list_min([{'c': a.c + 4, 's': a.s || 'D'}, CASE WHEN stays AND ini = 'a' THEN {'c': q.c + more, 's': q.s || 'K'} END,
                                     CASE WHEN stays THEN {'c': q.c + 3 + more, 's': q.s || 'R'} END]) AS a
                    FROM (
                        SELECT parse.conv, f.n, e, o, q, a, list_min([e, o, a]) AS p, ini,
                               fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more
                        FROM parse JOIN f ON f.conv = parse.conv AND f.n = parse.n + 1)))
        ), best AS (
            SELECT conv, list_min([e, a]) AS v FROM parse QUALIFY row_number() OVER (PARTITION BY conv ORDER BY n DESC) = 1
        ), letters AS (
            SELECT conv, v.c AS cost, v.s AS audit, unnest(range(1, length(v.s) + 1)) AS k FROM best
        ), edits AS (
            SELECT conv, audit, audit[k] AS edit, sum((audit[k] <> 'I')::INT) OVER w AS n, sum((audit[k] <> 'D')::INT) OVER w AS place
            FROM letters WINDOW w AS (PARTITION BY conv ORDER BY k)
        ), out AS (
            SELECT edits.conv, place, edit, f.role, coalesce(CASE WHEN edit <> 'I' THEN f.text END, '') AS text,
                   max((edit = 'K' AND f.ini = 's')::INT) OVER (PARTITION BY edits.conv) AS opened
            FROM edits LEFT JOIN f ON f.conv = edits.conv AND f.n = edits.n WHERE edit <> 'D'
        ), repaired AS (
            SELECT conv, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place)) AS h
            FROM out GROUP BY conv
        ), counts AS (
            SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv
        )
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.c, 0) AS cost,
               coalesce(v.s, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS conv FROM conversations)
        LEFT JOIN counts USING (conv) LEFT JOIN best USING (conv) LEFT JOIN repaired USING (conv)"""
}
