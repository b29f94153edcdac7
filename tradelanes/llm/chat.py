"""Chat formatting, checked by parsing what was rendered."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelanes.llm.common import arrow

BEGIN, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: What looks like a control string, with any number of backslashes in it already.
_LOOKALIKE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """One backslash more in everything that looks like the beginning of a control string."""
    return _LOOKALIKE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    """One backslash less; the reverse of ``escape``."""
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


class Malformed(ValueError):
    pass


class Parser:
    """A deterministic parser of ``BEGIN role newline text END newline``, fed in chunks of any size."""

    def __init__(self):
        self.rest = ""

    def feed(self, chunk: str) -> Iterator[tuple[str, str, str]]:
        """Role, text, and text as written, of every turn that is complete."""
        self.rest += chunk
        at = 0
        while True:
            found = self._turn(at)
            if found is None:
                self.rest = self.rest[at:]
                return
            role, text, at = found
            yield unescape_role(role), unescape(text), text

    def _turn(self, at: int) -> tuple[str, str, int] | None:
        data = self.rest
        if not data.startswith(BEGIN, at):
            if BEGIN.startswith(data[at:]):
                return None
            raise Malformed("a turn begins with the start mark")
        line = data.find("\n", at + len(BEGIN))
        if line < 0:
            return None
        end = data.find(END, line + 1)
        again = data.find(BEGIN, line + 1, end if end >= 0 else len(data))
        if again >= 0 or data.find(BEGIN, at + 1, line) >= 0 or data.find(END, at, line) >= 0:
            raise Malformed("a mark inside a turn")
        if end < 0 or len(data) == end + len(END):
            return None
        if data[end + len(END)] != "\n":
            raise Malformed("a line ends after the end mark")
        return data[at + len(BEGIN) : line], data[line + 1 : end], end + len(END) + 1

    def close(self) -> None:
        if self.rest:
            raise Malformed("the text ends inside a turn")


def parse(formatted: str) -> list[tuple[str, str]]:
    parser = Parser()
    turns = [(role, text) for role, text, _ in parser.feed(formatted)]
    parser.close()
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where its text begins and ends in it.

    First as it is; what the parser doesn't give back the same is escaped,
    first the text, then the role too, until it does.
    """
    for shown_role, shown in ((role, text), (role, escape(text)), (escape_role(role), escape(text))):
        out = f"{BEGIN}{shown_role}\n{shown}{END}\n"
        try:
            same = parse(out) == [(role, text)]
        except Malformed:
            same = False
        if same:
            start = len(BEGIN) + len(shown_role) + 1
            return out, start, start + len(shown)
    raise Malformed(f"no escaped form of {role!r} reads back the same")


def format_turns(turns: DataFrame) -> DataFrame:
    """``formatted`` for every turn, and the code points of it that carry loss, [``loss_from``, ``loss_to``).

    Turns need ``conv_id``, ``turn``, ``role``, ``text``. A conversation is
    its turns' texts end to end, in the order of ``turn``; equal turn numbers
    follow the order of role and text. Each turn is rendered by itself, so
    conversations of any length need no memory.
    """
    schema = "conv_id long, turn long, _role string, _text string, formatted string, loss_from int, loss_to int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("_role").to_pylist(), batch.column("_text").to_pylist()
            out = [render(role, text) for role, text in zip(roles, texts, strict=True)]
            loss = [(a, b) if role == TRAINED_ROLE else (0, 0) for role, (_, a, b) in zip(roles, out, strict=True)]
            yield arrow(
                schema,
                {
                    **{c: batch.column(c) for c in ("conv_id", "turn", "_role", "_text")},
                    "formatted": [x[0] for x in out],
                    "loss_from": [x[0] for x in loss],
                    "loss_to": [x[1] for x in loss],
                },
            )

    plain = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
    )
    return plain.mapInArrow(work, schema)


class _Read:
    """What is read of one conversation, as it streams by."""

    def __init__(self, conv_id):
        self.conv_id, self.parser = conv_id, Parser()
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, formatted: str, start: int, end: int) -> None:
        for role, text, _ in self.parser.feed(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        masked = unescape(formatted[start:end])
        self.loss_chars += len(masked)
        self.loss.update(masked.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        self.parser.close()
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed from what ``format_turns`` wrote.

    A conversation's turns stream through one task in order; the task keeps
    the parser's rest and two running digests, never the conversation.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Read | None = None
        names = [part.split()[0] for part in schema.split(",")]
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to"))
            for conv_id, text, start, end in zip(*columns, strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        rows.append(current.row())
                    current = _Read(conv_id)
                current.take(text, start, end)
            if rows:
                yield arrow(schema, dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
        if current is not None:
            yield arrow(schema, dict(zip(names, ([v] for v in current.row()), strict=True)))

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "_role", "_text")
        .select("conv_id", "formatted", "loss_from", "loss_to")
        .mapInArrow(work, schema)
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formats all conversations and returns what reading them back gives.

    Defined cases: missing texts and roles are empty; rows without ``conv_id``
    are one conversation; a missing turn number comes first; repeated rows are
    turns of their own. An empty table gives no rows. Other columns aren't
    read.
    """
    return read_back(format_turns(turns))
