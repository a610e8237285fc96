"""Chat formatting that is sure to read back: render, reparse, compare, escape, repeat.

Every turn is an opening mark, its text and a closing mark. A turn is rendered as it is and
read again by the parser; where the parser gives something else back, control
strings in the text are escaped by one more backslash until it gives the turn itself. The
grammar needs no look at other turns, so turns are formatted apart, however long their
conversation is.

The output is one row per turn: the formatted text, and the part of it under the loss mask.
A conversation is its rows in order, one after another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstream.llm.common import map_batches, text_or_empty

# Opening and closing marks by role; other roles are named inside the turn.
MARKS = {
    "system": ("<<SYS>>", "<</SYS>>"),
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
}
OTHER = ("[TURN]", "[/TURN]")
NAMED = "[AS]"
LOSS_ROLE = "assistant"
CONTROL = (*(mark for pair in MARKS.values() for mark in pair), *OTHER, NAMED)

# A control string with any number of backslashes after its first character.
_LIKE_CONTROL = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROL))


def escape(text: str) -> str:
    """One more backslash in everything like a control string."""
    return _LIKE_CONTROL.sub(lambda found: f"{found[0][0]}\\{found[0][1:]}", text)


def unescape(text: str) -> str:
    """One backslash less in every escaped control string."""
    return _ESCAPED.sub(lambda found: found[0][0] + found[0][2:], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text starts and ends in it."""
    opening, closing = MARKS.get(role, OTHER)
    head = opening if role in MARKS else f"{opening}{escape(role)}{NAMED}"
    return f"{head}{text}{closing}", len(head), len(head) + len(text)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted text; raises if it is none."""
    place = 0
    while place < len(formatted):
        for role, (opening, closing) in {**MARKS, "": OTHER}.items():
            if formatted.startswith(opening, place):
                break
        else:
            raise ValueError(f"no turn at {place}")
        place += len(opening)
        if not role:
            named = formatted.index(NAMED, place)
            role, place = unescape(formatted[place:named]), named + len(NAMED)
        end = formatted.index(closing, place)
        text = formatted[place:end]
        for mark in CONTROL:
            if mark in text:
                raise ValueError(f"{mark} inside a turn")
        yield role, unescape(text)
        place = end + len(closing)


def read_back(formatted: str) -> list[tuple[str, str]] | None:
    """The turns, or None for a text outside the grammar."""
    try:
        return list(parse(formatted))
    except ValueError:
        return None


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn that reads back as itself, and the place of its text."""
    shown = text
    rendered = render(role, shown)
    while read_back(rendered[0]) != [(role, text)]:
        escaped = escape(shown)
        if escaped == shown:
            raise ValueError("a turn that escapes do not help")
        shown = escaped
        rendered = render(role, shown)
    return rendered


FORMATTED = "formatted string, loss_start int, loss_end int"


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, and the loss span (NULL for roles that are not learned).

    One row per row. NULL text and NULL role count as empty; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, starts, ends = [], [], []
        for role, text in zip(*(batch.column(c).to_pylist() for c in ("role", "text"))):
            formatted, start, end = format_turn(role, text)
            learned = role == LOSS_ROLE
            texts.append(formatted)
            starts.append(start if learned else None)
            ends.append(end if learned else None)
        arrays = [batch.column("conv_id"), batch.column("turn"), pa.array(texts, pa.string())]
        arrays += [pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
        names = ["conv_id", "turn", "formatted", "loss_start", "loss_end"]
        return pa.RecordBatch.from_arrays(arrays, names)

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        text_or_empty(),
    )
    return map_batches(rows, run, f"conv_id long, turn long, {FORMATTED}")


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


class _Digest:
    """Sums up one conversation, turn by turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        for role, text in parse(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            learned = unescape(formatted[start:end])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.chars += len(formatted)

    def row(self) -> tuple:
        turns, loss = self.turns.hexdigest(), self.loss.hexdigest()
        return self.conv_id, self.n_turns, turns, self.loss_chars, loss, self.chars


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conv_id, read from the formatted turns. Equal turns are ordered by their text.

    Turns stream through their task in order; none is kept, so that a conversation of any
    length takes the same memory. Rows without conv_id are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Digest | None = None
        for batch in batches:
            done = []
            columns = ("conv_id", "formatted", "loss_start", "loss_end")
            for conv_id, *turn in zip(*(batch.column(c).to_pylist() for c in columns)):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conv_id)
                current.add(*turn)
            if done:
                yield _digest_batch(done)
        if current is not None:
            yield _digest_batch([current.row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(run, DIGESTS)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [field.split()[0] for field in DIGESTS.split(", ")]
    arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names)
