"""Chat formatting: final messages rebuilt from an event log, then rendered.

Events are rows (conversation, sequence, message, kind, role, text):
  delta       appends its text to the message
  edit        replaces what the message holds so far
  regenerate  empties the message; the deltas after it build the new version
  delete      removes the message
A message takes the role of its last event that has one, and its place from its
first event. Events are folded in the order of sequence; ties go by kind, role
and text, so repeated rows have a defined result. Null text counts as empty, null
role as an empty role, and a null sequence comes first. An empty log gives no
conversations. Other columns of the log don't count, whatever their names.

The log is dealt by conversation and sorted inside partitions; a conversation is
read as a stream, message by message, and never held whole: its formatted text is
made, and read back, in runs of turns of CHUNK characters or one turn. So a very long
text costs memory of some six times its size, and a long conversation none.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._workers import batchwise

#: Fixed values of the template: a turn opens with its role and closes with a mark.
OPEN, CLOSE, ESCAPE = "### {}:\n", "\n</turn>\n", "\\"
#: Characters of formatted turns that are read back together.
CHUNK = 1 << 16
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
_CONTROL = re.compile(r"(\\*)(###|</turn>)")
_ESCAPED = re.compile(r"\\(\\*)(###|</turn>)")


def escaped(text: str) -> str:
    """Each control string gets one more backslash before it, doubling those that stand there."""
    return _CONTROL.sub(lambda m: ESCAPE + m[1] * 2 + m[2], text) if "###" in text or "</turn>" in text else text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text) if "\\" in text else text


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """The turn's formatted text, and where the loss mask begins and ends in it."""
    head = OPEN.format(ROLES.get(role) or json.dumps(role))
    body = escaped(text)
    whole = head + body + CLOSE
    return (whole, len(head), len(head) + len(body)) if role == "assistant" else (whole, 0, 0)


_HEAD = re.compile(r'### (User|Assistant|System|"(?:[^"\\]|\\.)*"):\n')
_NAMES = {v: k for k, v in ROLES.items()}


def parsed(formatted: str) -> list[tuple[str, str, int, int]]:
    """role, text, and the body's place, of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = formatted.index(CLOSE, head.end())
        out.append((_NAMES.get(head[1]) or json.loads(head[1]), unescaped(formatted[head.end() : end]), head.end(), end))
        at = end + len(CLOSE)
    return out


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conversation, message, role, text) of each final message, from sorted events (conversation, message, kind, role, text).

    The events of one message stand together; only the open message is held.
    """
    key, role, parts, dead = None, "", [], True
    for conv, message, kind, r, text in events:
        if key != (conv, message):
            if not dead:
                yield (*key, role, "".join(parts))
            key, role, parts, dead = (conv, message), "", [], True
        role = role if r is None else r
        if kind == "delta":
            parts.append(text or "")
        elif kind in ("edit", "regenerate"):
            parts = [text or ""] if kind == "edit" else []
        elif kind != "delete":
            raise ValueError(f"unknown event kind {kind!r}")
        dead = kind == "delete"
        parts = [] if dead else parts
    if not dead:
        yield (*key, role, "".join(parts))


def sorted_log(events: DataFrame, place: str | None = None) -> DataFrame:
    """The log dealt by conversation, in order of each message's place and the sequence in it.

    events: conv_id, message_id, seq, kind, role, text. place: a column to order the messages
    by, or else it is the message's first seq.
    """
    dealt = events.select("conv_id", (F.col(f"`{place}`") if place else F.lit(None)).alias("place"), "message_id", "seq", "kind", "role", "text").repartition("conv_id")
    if place is None:
        message = W.partitionBy("conv_id", "message_id")
        dealt = dealt.withColumn("place", F.when(F.count(F.when(F.col("seq").isNull(), 1)).over(message) == 0, F.min("seq").over(message)))
    return dealt.sortWithinPartitions(*[F.asc_nulls_first(c) for c in dealt.columns])


def _stream(batches) -> Iterator[tuple]:
    for batch in batches:
        message = zip(batch["place"].to_pylist(), batch["message_id"].to_pylist(), strict=True)
        yield from zip(batch["conv_id"].to_pylist(), message, batch["kind"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True)


def final_messages(events: DataFrame, place: str | None = None) -> DataFrame:
    """conv_id, turn (0, 1, ...), role, text and formatted of every final message of an event log."""
    schema = T.StructType.fromDDL(f"conv_id {dict(events.dtypes)['conv_id']}, turn int, role string, text string, formatted string")
    kinds = [f.type for f in to_arrow_schema(schema)]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    def run(batches):
        rows, conv, turn = [], object(), 0
        for c, _, role, text in fold(_stream(batches)):
            conv, turn = c, (turn + 1 if c == conv else 0)
            rows.append((c, turn, role, text, rendered(role, text)[0]))
            if len(rows) == 1000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return sorted_log(events, place).mapInArrow(batchwise(run), schema)


class Digest:
    """Figures of one conversation, from what is read back of its formatted text."""

    def __init__(self):
        self.n = self.chars = self.loss_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.parts, self.masks, self.size = [], [], 0

    def add(self, role: str, text: str) -> None:
        whole, a, b = rendered(role, text)
        if b > a:
            self.masks.append((self.size + a, self.size + b))
        self.parts.append(whole)
        self.size += len(whole)
        if self.size >= CHUNK:
            self.read_back()

    def read_back(self) -> None:
        formatted = "".join(self.parts)
        for role, text, _, _ in parsed(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for a, b in self.masks:
            masked = unescaped(formatted[a:b])
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
        self.chars += len(formatted)
        self.parts, self.masks, self.size = [], [], 0

    def row(self) -> tuple:
        self.read_back()
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(events: DataFrame, place: str | None = None) -> DataFrame:
    """One row per conversation of a log, read back from its formatted text over the borders of turns."""
    schema = T.StructType.fromDDL(f"conv_id {dict(events.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    kinds = [f.type for f in to_arrow_schema(schema)]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    def run(batches):
        rows, conv, open_ = [], None, None
        for c, _, role, text in fold(_stream(batches)):
            if open_ is None or c != conv:
                if open_:
                    rows.append((conv, *open_.row()))
                if len(rows) == 1000:
                    yield batch(rows)
                    rows = []
                conv, open_ = c, Digest()
            open_.add(role, text)
        if open_:
            rows.append((conv, *open_.row()))
        if rows:
            yield batch(rows)

    return sorted_log(events, place).mapInArrow(batchwise(run), schema)


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Finished turns as a log, with a place for each: a draft that is regenerated, a wrong beginning that is edited, and the rest of the text.

    Behind each turn stands a message that is deleted. turns: conv_id, turn, role, text.
    Rows of one turn are messages of their own, in order of role and text; equal rows
    stay apart.
    """
    order = W.partitionBy("conv_id", "turn").orderBy(F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    plain = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    numbered = plain.repartition("conv_id").withColumn("message_id", F.row_number().over(order))
    half = "cast(char_length(text) / 2 as int)"
    steps = F.expr(f"""inline(array(
        named_struct('message_id', message_id, 'seq', 0, 'kind', 'delta', 'text', substring(text, 1, 8)),
        named_struct('message_id', message_id, 'seq', 1, 'kind', 'regenerate', 'text', ''),
        named_struct('message_id', message_id, 'seq', 2, 'kind', 'delta', 'text', 'wrong'),
        named_struct('message_id', message_id, 'seq', 3, 'kind', 'edit', 'text', substring(text, 1, {half})),
        named_struct('message_id', message_id, 'seq', 4, 'kind', 'delta', 'text', substring(text, {half} + 1)),
        named_struct('message_id', -message_id, 'seq', 0, 'kind', 'delta', 'text', 'dropped'),
        named_struct('message_id', -message_id, 'seq', 1, 'kind', 'delete', 'text', '')))""")
    parts = numbered.select("conv_id", F.col("turn").alias("place"), "message_id", F.coalesce("role", F.lit("")).alias("role"), "text")
    return parts.select("conv_id", "place", "role", steps)
