"""Chat rendering that reads back exactly.

Grammar of the rendered conversation::

    conversation = turn*
    turn         = "<s>" tag text close "</s>"
    tag          = "[SYS]" | "[INST]" | "[REPLY]" | "[ROLE:" role "]"
    close        = "[/" name "]"                       the name of the turn's tag
    text, role   = (character | "\\" character)*       without an unescaped control string

A backslash makes the next character plain.  Each turn is rendered at the lowest escape level whose parse gives
the same role and text: 0 escapes nothing, 1 a character in front of each control string and backslash, 2 every character
that could begin one.  The reader is strict: a control string where the grammar has none is an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.rows import small_batches

# The template's marks.
TAGS = {"system": "SYS", "user": "INST", "assistant": "REPLY"}
OPEN, END = "<s>", "</s>"
_ROLES = {v: k for k, v in TAGS.items()}
_CONTROL = re.compile(r"\\|</?s>|\[/?(?:SYS|INST|REPLY)\]|\[ROLE:|\[/ROLE\]")
_SPECIAL = re.compile(r"[\\<>\[\]]")
_MARK = re.compile(r"\\[\s\S]|</?s>|\[/?(?:SYS|INST|REPLY)\]|\[ROLE:|\[/ROLE\]|\\\Z")
LEARNED = "assistant"


def escape(text: str, level: int) -> str:
    return text if level == 0 else (_CONTROL if level == 1 else _SPECIAL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text)


def render(role: str, text: str, level: int) -> tuple[str, int, int]:
    """The turn's string, and where its text begins and ends in it."""
    tag = TAGS.get(role)
    head = f"{OPEN}[{tag}]" if tag else f"{OPEN}[ROLE:{escape(role, 2)}]"
    body = escape(text, level)
    return f"{head}{body}[/{tag or 'ROLE'}]{END}", len(head), len(head) + len(body)


def _until(text: str, at: int, closing: str) -> int:
    """Where the first unescaped control string begins, which must be ``closing``."""
    for m in _MARK.finditer(text, at):
        if m[0][0] != "\\":
            if m[0] != closing:
                raise ValueError(f"{m[0]} at {m.start()}, not {closing}")
            return m.start()
        if len(m[0]) == 1:
            break
    raise ValueError(f"no {closing} after {at}")


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the span of the escaped text for each turn of a rendered string."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        at += len(OPEN)
        tag = re.compile(r"\[(SYS|INST|REPLY)\]|\[ROLE:((?:\\[\s\S]|[^\\\]])*)\]").match(text, at)
        if not tag:
            raise ValueError(f"no tag at {at}")
        role = _ROLES[tag[1]] if tag[1] else unescape(tag[2])
        closing = f"[/{tag[1] or 'ROLE'}]"
        end = _until(text, tag.end(), closing)
        turns.append((role, unescape(text[tag.end() : end]), tag.end(), end))
        at = end + len(closing)
        if not text.startswith(END, at):
            raise ValueError(f"turn not ended at {at}")
        at += len(END)
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """The turn rendered at the first escape level that reads back identical, its text span and that level."""
    for level in (0, 1, 2):
        segment, a, b = render(role, text, level)
        try:
            if parse(segment) == [(role, text, a, b)]:
                return segment, a, b, level
        except ValueError:
            pass
    raise AssertionError("the last escape level always reads back")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, segment, loss_from, loss_to, level): the rendered turns; joined in order of
    (turn, segment) they are the conversation.  The loss span (null but for the assistant) is in code
    points of the segment.  A conversation stays in segments since it may be longer than one value can be.

    A null role is the empty role, a null text the empty text; null conv_ids form one conversation, null turns
    come first.  Repeated rows are repeated turns.  Other columns are not read.
    """
    small_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = ([x or "" for x in batch.column(i).to_pylist()] for i in (2, 3))
            made = [format_turn(*x) for x in zip(roles, texts, strict=True)]
            learned = [r == LEARNED for r in roles]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] if x else None for m, x in zip(made, learned, strict=True)], pa.int64()),
                 pa.array([m[2] if x else None for m, x in zip(made, learned, strict=True)], pa.int64()), pa.array([m[3] for m in made], pa.int32())],
                ["conv_id", "turn", "segment", "loss_from", "loss_to", "level"],
            )

    base = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "conv_id long, turn long, segment string, loss_from long, loss_to long, level int")


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, a: int | None, b: int | None) -> None:
        for role, text, _, _ in parse(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if a is not None:
            learned = unescape(segment[a:b])
            self.loss += len(learned)
            self.learned.update(learned.encode())
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


def read_back(segments: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read from rendered segments.

    The digests run over a conversation's segments in order, one batch at a time: a task holds a batch and the
    digest states, however long a conversation is.  (SHA-256 is sequential, so one conversation is one task's work.)
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for conv_id, segment, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(segment, a, b)
            if done:
                yield out(done)
        if now is not None:
            yield out([now.row()])

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
