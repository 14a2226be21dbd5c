"""Chat formatting: turns of conversations as budgeted windows of template text with a loss mask.

A conversation is cut into spans of whole turns.  Prefix sums of turn tokens choose them: a span ends
where the next turn would take the window over its budget.  Each window retains the conversation's system
turn and repeats a little history before its new turns; what is repeated is masked, so every assistant
text is a target exactly once.  The template marks turns with control strings, and control strings inside
texts are escaped so that a window can be read back exactly.

Turns are dealt by (conversation, stretch of turn numbers), so a conversation of any length is shared out;
system turn and last turns before a stretch are copied into it.  A task streams its turns in order and
holds one batch, one open window and the history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import fresh, small_batches

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
SYSTEM, ASSISTANT = "system", "assistant"
MARKS = 4              # tokens that a turn has besides its text
SALTS = 16
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_HEAD, _HISTORY, _NEW = 0, 1, 2


def escape(text: str) -> str:
    r"""No ``<|`` is left: ``<``, k backslashes and ``|`` get one backslash more."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def template(role: str, text: str) -> tuple[str, int, int]:
    """One turn as template text, and where its escaped text stands (code points)."""
    head = START + escape(role).replace("\n", LINE) + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def read_window(formatted: str, repeated: int, loss: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """The (role, text) turns of a window that are not repeated, and the texts under the loss mask."""
    turns = [(unescape(role.replace(LINE, "\n")), unescape(body)) for role, body in _TURN.findall(formatted)]
    return turns[repeated:], [unescape(formatted[a:b]) for a, b in loss]


def span_end(prefix: list[int], first: int, room: int) -> int:
    """End of the span from turn ``first``: the most turns whose tokens, by prefix sums, are at most ``room``; one at least."""
    return max(first + 1, int(np.searchsorted(prefix, prefix[first] + room, "right")) - 1)


class Packer:
    """Windows of one stretch of a conversation; turns come in order as (role, text, tokens)."""

    def __init__(self, budget: int, history: int, share: float):
        self.budget, self.most, self.share = budget, history, int(budget * share)
        self.begins = True                   # no window of the conversation so far
        self.head: tuple | None = None       # the system turn, once it stands in an earlier window
        self.past: list[tuple] = []          # the last turns of earlier windows, the system turn left out
        self.open: list[tuple] = []

    def repeated(self, next_tokens: int) -> list[tuple]:
        """System turn and history of the next window: history has at most a share of the budget, and room beside the next turn."""
        head = [self.head] if self.head else []
        room = min(self.share, self.budget - sum(t[2] for t in head) - next_tokens)
        some: list[tuple] = []
        for turn in reversed(self.past):
            room -= turn[2]
            if room < 0:
                break
            some.insert(0, turn)
        return head + some

    def add(self, turns: list[tuple], last: bool) -> Iterator[dict]:
        """Windows that are complete with these turns; the open one is kept unless they are the last."""
        self.open += turns
        prefix = [0, *accumulate(t[2] for t in self.open)]
        at = 0
        while at < len(self.open):
            again = self.repeated(self.open[at][2])
            end = span_end(prefix, at, self.budget - sum(t[2] for t in again))
            if end == len(self.open) and not last:
                break
            yield self.window(again, self.open[at:end])
            if self.begins and self.open[at][0] == SYSTEM:
                self.head = self.open[at]
            self.begins = False
            self.past = [t for t in self.past + self.open[at:end] if t is not self.head][-self.most:] if self.most else []
            at = end
        del self.open[:at]

    @staticmethod
    def window(again: list[tuple], new: list[tuple]) -> dict:
        parts, loss, at = [], [], 0
        for k, (role, text, _) in enumerate(again + new):
            made, begin, end = template(role, text)
            if role == ASSISTANT and k >= len(again):
                loss.append({"start": at + begin, "end": at + end})
            parts.append(made)
            at += len(made)
        return {"repeated": len(again), "tokens": sum(t[2] for t in again + new), "formatted": "".join(parts), "loss": loss}


_SCHEMA = pa.schema([("conv", pa.int64()), ("stretch", pa.int64()), ("window", pa.int64()), ("repeated", pa.int32()), ("tokens", pa.int64()),
                     ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_DDL = ("conv long, stretch long, window long, repeated int, tokens long, formatted string, loss array<struct<start: long, end: long>>")


def _packed(budget: int, history: int, share: float):
    """Rows (conv, stretch, kind, role, text, tokens), sorted, to windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer, made = None, None, 0

        def add(turns, last):
            nonlocal made
            rows = []
            for window in packer.add(turns, last):
                rows.append({"conv": now[0], "stretch": now[1], "window": made, **window})
                made += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

        for batch in batches:
            turns: list[tuple] = []
            for conv, stretch, kind, role, text, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (conv, stretch):
                    if packer:
                        yield from add(turns, True)
                    now, packer, made, turns = (conv, stretch), Packer(budget, history, share), 0, []
                turn = (role, text, tokens)
                if kind == _HEAD:
                    packer.begins, packer.head = False, turn if role == SYSTEM else None
                elif kind == _HISTORY:
                    if turn != packer.head:
                        packer.past = (packer.past + [turn])[-history:]
                else:
                    turns.append(turn)
            if packer:
                yield from add(turns, False)
        if packer:
            yield from add([], True)

    return run


def word_tokens(text: Column) -> Column:
    """The words of a text: the default measure of the budget."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def windows(turns: DataFrame, budget: int = 512, history: int = 2, share: float = 0.25, stretch: int = 4096, conv: str = "conv_id",
            turn: str = "turn", role: str = "role", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(conv, stretch, window, repeated, tokens, formatted, loss): the windows of every conversation, in order of (stretch, window).

    ``formatted`` is template text of whole turns; its first ``repeated`` turns stood in an earlier window:
    the conversation's first turn if its role is system, then at most ``history`` turns of together at
    most ``share`` of the budget.  ``loss`` holds the spans (code points) of the escaped assistant texts
    that are new.  ``tokens`` counts a turn (default: words), to which four are added for its marks.  Only a
    window of one new turn can exceed the budget: turns are never cut.

    Turns are ordered by number, then role and text; those without a number come last, in windows of
    their own.  Null roles and texts count as empty, rows with a null id are one conversation, repeated
    rows are turns of their own.  No window crosses a multiple of ``stretch`` turn numbers; the rows of one
    stretch are streamed by one task.  Other columns are neither needed nor returned.
    """
    if not 0 <= history < stretch:
        raise ValueError("history must be shorter than a stretch of turns")
    small_batches(turns.sparkSession)
    (size,) = fresh(turns, "_tokens")
    counted = word_tokens(F.coalesce(F.col(text), F.lit(""))) if tokens is None else tokens
    number = F.col(turn).cast("long")
    rows = turns.withColumn(size, counted).select(
        F.col(conv).cast("long").alias("conv"), F.coalesce(F.floor(number / F.lit(stretch)), F.lit(1 << 62)).cast("long").alias("stretch"),
        F.lit(_NEW).alias("kind"), number.alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), (F.coalesce(F.col(size), F.lit(0)) + MARKS).cast("long").alias("tokens"))
    tail = rows.filter(F.pmod("at", F.lit(stretch)) >= stretch - history).select(
        "conv", (F.col("stretch") + 1).alias("stretch"), F.lit(_HISTORY).alias("kind"), "at", "role", "text", "tokens")
    every = rows.unionByName(tail)
    parts = rows.groupBy("conv").agg(F.min("stretch").alias("first"), F.max("stretch").alias("last"))
    several = parts.filter("first < last").withColumnRenamed("conv", "c")
    if not several.isEmpty():
        mine = F.col("conv").eqNullSafe(F.col("c"))
        turn_of = F.struct(F.col("at").isNull().alias("last"), "at", "role", "text", "tokens")
        heads = (rows.join(several, mine & (F.col("stretch") == F.col("first"))).groupBy("conv").agg(F.min(turn_of).alias("h"))
                 .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        others = (rows.select("conv", "stretch").distinct().join(several, mine & (F.col("stretch") != F.col("first")))
                  .select("conv", "stretch", F.pmod("stretch", F.lit(SALTS)).cast("int").alias("salt")))
        copies = others.alias("o").join(heads.alias("h"), F.col("o.conv").eqNullSafe(F.col("h.conv")) & (F.col("o.salt") == F.col("h.salt")))
        every = every.unionByName(copies.select("o.conv", "o.stretch", F.lit(_HEAD).alias("kind"), "h.h.at", "h.h.role", "h.h.text", "h.h.tokens"))
    dealt = (every.repartition(F.xxhash64("conv", "stretch"))
             .sortWithinPartitions("conv", "stretch", "kind", F.col("at").asc_nulls_last(), "role", "text"))
    return dealt.select("conv", "stretch", "kind", "role", "text", "tokens").mapInArrow(_packed(budget, history, share), _DDL)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, repeated, formatted, loss) in order to one row per conversation, read from the windows alone."""
    now, state = None, None
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(names, (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])))],
                                          pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))))

    for batch in batches:
        for conv, repeated, formatted, loss in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (conv,):
                if now:
                    yield row()
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns, targets = read_window(formatted, repeated, [(s["start"], s["end"]) for s in loss])
            for role, text in turns:
                state[1].update(f"{role}\n{text}\n".encode())
            for text in targets:
                state[2] += len(text)
                state[3].update(text.encode())
            state[0] += len(turns)
            state[4] += len(formatted)
    if now:
        yield row()


def conversation_digests(made: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, read back from its windows.

    A digest runs over its text in order, so one task streams all windows of a conversation; it holds none of them.
    """
    ordered = made.repartition(F.xxhash64("conv")).sortWithinPartitions("conv", "stretch", "window")
    return ordered.select("conv", "repeated", "formatted", "loss").mapInArrow(
        _digests, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def windows_sql(said: str, budget: int = 512, history: int = 2, share: float = 0.25) -> str:
    """The digests over the table ``conversations`` and conversation -1, whose two turns both say ``said``.

    Spans are found one after the other by recursion, for conversations within one stretch and a history of two.
    """
    if history != 2:
        raise ValueError("the SQL looks back two turns")
    escaped = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
    said = said.replace("'", "''")
    return rf"""WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}')),
 t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k,
   len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {MARKS} AS size, {len(START) + 1 + len(END)} + length(replace({escaped.format("role")}, chr(10), '{LINE}'))
   + length({escaped.format("text")}) AS chars FROM r),
 l AS (SELECT conv_id, count(*) AS n, list(size ORDER BY k) AS s, list(chars ORDER BY k) AS c, first(role ORDER BY k) = 'system' AS system FROM t GROUP BY conv_id),
 w AS (SELECT conv_id, CAST(1 AS BIGINT) AS place, CAST(0 AS BIGINT) AS made FROM l
  UNION ALL
  SELECT conv_id, stop AS place, CAST(made + headed * c[1] + coalesce(one * c[place - 1], 0) + coalesce(two * c[place - 2], 0) + list_sum(c[place:stop - 1]) AS BIGINT) AS made FROM (
   SELECT *, list_max(list_filter(range(place + 1, n + 2), lambda e: e = place + 1 OR list_sum(s[place:e - 1]) + headed * s[1] + coalesce(one * s[place - 1], 0) + coalesce(two * s[place - 2], 0) <= {budget})) AS stop FROM (
   SELECT *, CASE WHEN one = 1 AND place - 2 > headed AND s[place - 1] + s[place - 2] <= room THEN 1 ELSE 0 END AS two FROM (
   SELECT *, CASE WHEN place - 1 > headed AND s[place - 1] <= room THEN 1 ELSE 0 END AS one FROM (
   SELECT *, least({int(budget * share)}, {budget} - headed * s[1] - s[place]) AS room FROM (
   SELECT conv_id, place, made, n, s, c, CASE WHEN system AND place > 1 THEN 1 ELSE 0 END AS headed FROM w JOIN l USING (conv_id) WHERE place <= n)))))),
 f AS (SELECT conv_id, max(made) AS formatted_chars FROM w GROUP BY conv_id)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, formatted_chars
 FROM t JOIN f USING (conv_id) GROUP BY conv_id, formatted_chars"""
