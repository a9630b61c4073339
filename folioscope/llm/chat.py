"""Chat formatting: a finite-state machine over roles and a declarative template.

Rows of a conversation are ordered by turn (nulls first; ties by role, then text) and formatted as
they stream by, so that the longest conversation needs the memory of one batch of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

#: Bytes of text, and formatted rows, that a worker turns into Python objects at once.
PIECE, ROWS = 4 << 20, 64
SEGMENTS = "array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Template:
    """A turn is head, role, colon, text, tail. The first sign of head and tail (and, in a role, that
    of colon) and the escape sign itself get the escape sign in front wherever they stand in a role or
    text, so no text can be taken for a mark and reading back is exact.

    moves: state -> role -> next state, from "start"; a missing role breaks the order, and the machine
    goes on from the state that the role is named for. A conversation is valid if nothing broke the
    order and it ends in one of `final`."""

    head: str = "### "
    colon: str = ": "
    tail: str = " </turn>\n"
    escape: str = "\\"
    trained: tuple[str, ...] = ("assistant",)
    moves: dict = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user", "tool": "tool"}, "tool": {"assistant": "assistant"}})
    final: tuple[str, ...] = ("assistant",)

    def escaped(self, text: str, also: str = "") -> str:
        for sign in (self.escape, self.head[0], self.tail.lstrip()[0], *also):
            text = text.replace(sign, self.escape + sign)
        return text

    def plain(self, text: str, also: str = "") -> str:
        """What escaped() was given. An escape sign stands before each sign, so in a run of escape signs
        before one the last is the sign's; the rest are pairs."""
        for sign in (self.tail.lstrip()[0], self.head[0], *also):
            text = text.replace(self.escape + sign, sign)
        return text.replace(self.escape * 2, self.escape)

    def segments(self, role: str, text: str) -> list[dict]:
        marks = self.head + self.escaped(role, self.colon[0]) + self.colon
        return [{"text": marks, "loss": False}, {"text": self.escaped(text), "loss": role in self.trained}, {"text": self.tail, "loss": False}]

    def step(self, state: str, role: str) -> tuple[str, bool]:
        after = self.moves.get(state, {}).get(role)
        return (after, True) if after else (role if role in self.moves else state, False)

    def _end(self, formatted: str, mark: str, at: int) -> int:
        """Where the first `mark` from `at` begins whose guarded sign is not escaped; -1 if none does."""
        to = formatted.find(mark, at)
        while to >= 0:
            n = to
            while n > at and formatted[n - 1] == self.escape:
                n -= 1
            # Behind white space that is the mark's own, its sign can't be an escaped one.
            if mark[0].isspace() or (to - n) % 2 == 0:
                return to
            to = formatted.find(mark, to + 1)
        return -1

    def parsed(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) of each turn of a formatted text; ValueError if anything is left over. Marks
        are found by searching for them, so a turn costs a few copies of its text and no more."""
        out, at = [], 0
        while at < len(formatted):
            begin = at + len(self.head)
            mid = self._end(formatted, self.colon, begin) if formatted.startswith(self.head, at) else -1
            end = self._end(formatted, self.tail, mid + len(self.colon)) if mid >= 0 else -1
            if end < 0:
                raise ValueError(f"no turn at {at}")
            out.append((self.plain(formatted[begin:mid], self.colon[0]), self.plain(formatted[mid + len(self.colon) : end])))
            at = end + len(self.tail)
        return out


def format_chats(rows: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn, in order within a partition: conv_id, position (from 0), ok (the machine
    could take the turn), state after it, and segments of text with loss flags.

    A null role or text is empty. Conversations of any order are formatted; ok says where order breaks.
    Rows with a null conv_id are one conversation; rows with equal turns go by role, then text, and
    equal rows are turns of their own. A long text costs a few copies of itself. Other columns are not
    read; no rows, no output."""
    t, kind = template or Template(), rows.schema[conv].dataType
    picked = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("position", T.LongType()), T.StructField("ok", T.BooleanType()), T.StructField("state", T.StringType())])
    schema = T.StructType([*schema, *T.StructType.fromDDL(f"segments {SEGMENTS}")])
    inner = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches):
        current, state, n = object(), "start", 0
        for b in (x for batch in batches for x in pieces(batch, "text", PIECE)):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for c, r, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c != current:
                    current, state, n = c, "start", 0
                state, ok = t.step(state, r)
                for col, v in zip(out, (n, ok, state, t.segments(r, x)), strict=True):
                    col.append(v)
                n += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.string()), pa.array(out[3], inner)], names=schema.names)

    return picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.n, self.chars = conv, hashlib.sha256(), 0, 0
        self.loss, self.loss_chars, self.bad, self.state = hashlib.sha256(), 0, None, "start"

    def add(self, t: Template, segments: list[dict], ok: bool, state: str) -> None:
        whole = "".join(s["text"] for s in segments)
        for role, text in t.parsed(whole):
            self.turns.update(f"{role}\n{text}\n".encode())
            if not ok and self.bad is None:
                self.bad = self.n
            self.n += 1
        trained = "".join(t.plain(s["text"]) for s in segments if s["loss"])
        self.loss.update(trained.encode())
        self.loss_chars += len(trained)
        self.chars += len(whole)
        self.state = state

    def row(self, t: Template) -> dict:
        return {"conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "valid": self.bad is None and self.state in t.final, "error_turn": self.bad}


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What is read back from the rows of format_chats, in their order: one row for each conversation."""
    t, kind = template or Template(), formatted.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("valid", T.BooleanType()), T.StructField("error_turn", T.LongType())])
    names = schema.names

    def emit(done: list[_Digest], like: pa.DataType) -> pa.RecordBatch:
        rows = [d.row(t) for d in done]
        kinds = [like, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, like = None, None
        for b in (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS)):
            done, like = [], b.schema.field(0).type
            for c, ok, state, segments in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if now is None or c != now.conv:
                    if now:
                        done.append(now)
                    now = _Digest(c)
                now.add(t, segments, ok, state)
            if done:
                yield emit(done, like)
        if now:
            yield emit([now], like)

    return formatted.mapInArrow(run, schema)
