"""Operator 3: chat formatting with a grammar round trip.

A turn is rendered by a template of control strings. The rendered text is parsed again by a deterministic
parser, and the recovered turn is compared with the source. If they differ, the text is escaped, at the next
level, until they are the same: level 0 leaves it alone, level 1 breaks up the control strings, level 2 puts
the escape sign before each sign that control strings are made of. The parser undoes all levels alike.

Turns are rendered and checked one by one, before any shuffle. A rendered turn ends with its closing control
string, so a conversation is the concatenation of its turns. Digests of whole conversations come from the
output: the turns of a conversation are streamed in order through the parser, and no conversation is held in
memory. A digest such as SHA-256 is sequential, so one conversation is read by one task.

Defined cases: a null text is an empty one; a null role is the empty role; roles other than system, user and
assistant use the general form; empty texts keep their turn; rows of one conversation and turn stand in the
order of their rendered text; a null turn comes first; rows without conv_id form one conversation with a null
id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"

#: The control strings of the template, as opening and closing string of each role.
ROLES = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s>", "</s>"),
}
OTHER = ("<|role|>", "<|text|>", "<|end|>")

CONTROL = re.compile("|".join(re.escape(s.strip()) for s in [*(m for pair in ROLES.values() for m in pair), *OTHER]))
SIGNS = re.compile(r"[<\[\\|\]>]")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:
        return CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))
    return SIGNS.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if ESCAPE in text else text


@dataclass
class Parser:
    """Feed it text; it gives the turns (role, text) that are complete."""

    buffer: str = ""
    turns: list[tuple[str, str]] = field(default_factory=list)

    def _until(self, at: int, close: str) -> tuple[str, int] | None:
        """The raw text from ``at`` to the closing string, and where that ends. The next control string must be it."""
        found = CONTROL.search(self.buffer, at)
        if found is None:
            return None
        body = close.strip()
        begin = found.start() - close.index(body)
        if found[0] != body or begin < at or not self.buffer.startswith(close[: close.index(body)] + body, begin):
            raise GrammarError(f"{found[0]!r} in a text")
        if len(self.buffer) < begin + len(close):
            return None
        if not self.buffer.startswith(close, begin):
            raise GrammarError(f"{close!r} is cut short")
        return self.buffer[at:begin], begin + len(close)

    def feed(self, text: str) -> list[tuple[str, str]]:
        self.buffer += text
        done: list[tuple[str, str]] = []
        at = 0
        while at < len(self.buffer):
            if self.buffer.startswith(OTHER[0], at):
                role = self._until(at + len(OTHER[0]), OTHER[1])
                rest = role and self._until(role[1], OTHER[2])
                if not rest:
                    break
                done.append((unescape(role[0]), unescape(rest[0])))
                at = rest[1]
                continue
            for name, (opening, closing) in ROLES.items():
                if self.buffer.startswith(opening, at):
                    break
            else:
                raise GrammarError("no turn begins here")
            rest = self._until(at + len(opening), closing)
            if not rest:
                break
            done.append((name, unescape(rest[0])))
            at = rest[1]
        self.buffer = self.buffer[at:]
        return done

    def close(self) -> None:
        if self.buffer:
            raise GrammarError("the last turn is not complete")


def parse(text: str) -> list[tuple[str, str]]:
    parser = Parser()
    turns = parser.feed(text)
    parser.close()
    return turns


def render(role: str, text: str, level: int) -> tuple[str, int, int]:
    """The rendered turn, and where its text begins and ends in it."""
    body = escape(text, level)
    if role in ROLES:
        opening, closing = ROLES[role]
    else:
        opening, closing = OTHER[0] + escape(role, level) + OTHER[1], OTHER[2]
    return opening + body + closing, len(opening), len(opening) + len(body)


def format_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """The rendered turn at the first level whose round trip gives the source, its text's bounds, and the level."""
    for level in range(3):
        rendered, begin, end = render(role, text, level)
        try:
            if parse(rendered) == [(role, text)]:
                return rendered, begin, end, level
        except GrammarError:
            pass
    raise GrammarError(f"no level keeps {role!r}: {text!r}")


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turn, role, text. Returns conv_id, turn, formatted, loss_start, loss_end (code points within
    formatted; the text of assistant turns, else null) and level, a row for each turn."""
    schema = "conv_id long, turn long, formatted string, loss_start int, loss_end int, level int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                rendered, begin, end, level = format_turn(role or "", text or "")
                masked = role == "assistant"
                for column, value in zip(columns, (rendered, begin if masked else None, end if masked else None, level), strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [c.split(" ")[0] for c in schema.split(", ")])

    rows = turns.select(*(F.col(c).cast(k).alias(c) for c, k in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    return rows.mapInArrow(run, schema)


class Digest:
    """What one conversation's output says, as it streams by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.parser = conv_id, Parser()
        self.n = self.loss = self.chars = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, begin: int | None, end: int | None) -> None:
        self.chars += len(formatted)
        for role, text in self.parser.feed(formatted):
            self.n += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode())
        if begin is not None:
            text = unescape(formatted[begin:end])
            self.loss += len(text)
            self.loss_hash.update(text.encode())

    def row(self) -> tuple:
        self.parser.close()
        return self.conv_id, self.n, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of the rows of ``format_conversations``."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split(" ")[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Digest | None = None
        for batch in batches:
            done = []
            for conv_id, text, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = Digest(conv_id)
                now.add(text, begin, end)
            if done:
                yield rows(done)
        yield rows([now.row()] if now else [])

    ordered = formatted.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)
