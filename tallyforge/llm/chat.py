"""Chat formatting with loss masks, from templates that are black boxes.

A template is any function from turns (role, text) to a string.  Successive prefixes of
a conversation are rendered; where a rendering extends the one before it, the extension
is the turn's span.  Two one-character texts in the turn's place show where in the
span its text begins and how much follows it.  A rendering that doesn't extend the one
before it rewrites history: such a conversation is counted in ``rewrites`` and gets no mask.

:class:`Marked` is the template of the query: every turn stands between marks of its
role, and control strings inside texts get a backslash that reading back takes away.
It says of itself that turns are rendered ``alone``; prefixes then start anew every
``WINDOW`` turns, and a long conversation is cut into rows of about ``ROW_CHARS``
characters, wherever in the sorted rows its turns lie.  With other templates a
conversation is one task's work, rendered whole.

The output is a Parquet table (part, place, conv_id, first, last, text, turns, mask): the
rows of a conversation in order of (part, place) are its text, ``mask`` says which code points of
the row count in the loss.  ``digest`` reads such a table back.

Null conversation ids are one conversation; null turns come first, ties go by role and then by the MD5 of
the text. A null role or text is empty, repeated rows are turns each, very long texts stay whole, an empty table
gives an empty output, and other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm.common import bounded_batches

Turn = tuple[str, str]
#: Prefixes of so many turns at most are rendered together by a template whose turns stand alone.
WINDOW = 16
#: Characters after which a row of the output ends, at the next turn.
ROW_CHARS = 1 << 20

_SPAN = "start int, stop int"
SCHEMA = f"part int, place long, conv_id {{id}}, first boolean, last boolean, n_turns long, rewrites long, text string, turns array<struct<{_SPAN}>>, mask array<struct<{_SPAN}>>"


class Marked:
    """Turns between the marks of their role; marks inside texts are escaped, so that it reads back."""

    alone = True
    MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
    OTHER = ("[TURN] ", " [/TURN]")
    _control = re.compile(r"([\[<]/?)(\\*)((?:INST|SYS|TURN)\]|s>)")
    _turn = re.compile(r"(?s)\[INST\] (?P<user>.*?) \[/INST\]|<s> (?P<assistant>.*?) </s>|\[SYS\] (?P<system>.*?) \[/SYS\]|\[TURN\] (?P<role>[^\n]*)\n(?P<other>.*?) \[/TURN\]")

    def escape(self, text: str) -> str:
        """Each control string, escaped or not, gets one more backslash: none is left without."""
        return self._control.sub(r"\1\\\2\3", text)

    def unescape(self, text: str) -> str:
        return self._control.sub(lambda m: m[1] + m[2][1:] + m[3], text)

    def __call__(self, turns: list[Turn]) -> str:
        out = []
        for role, text in turns:
            if role in self.MARKS:
                before, after = self.MARKS[role]
            else:
                before, after = self.OTHER[0] + self.escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n", self.OTHER[1]
            out.append(before + self.escape(text) + after)
        return "".join(out)

    def read(self, rendered: str) -> list[Turn]:
        """The turns that gave a rendering; anything else is an error."""
        out, at = [], 0
        while at < len(rendered):
            m = self._turn.match(rendered, at)
            if not m:
                raise ValueError("not a rendering of this template")
            if m["other"] is not None:
                role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], self.unescape(m["role"]))
                out.append((role, self.unescape(m["other"])))
            else:
                out.append((m.lastgroup, self.unescape(m[m.lastgroup])))
            at = m.end()
        return out


class Prefixes:
    """Renders a conversation turn by turn and says where each turn and its text lie."""

    def __init__(self, template: Callable[[list[Turn]], str]):
        self.template, self.alone = template, getattr(template, "alone", False)
        self.turns: list[Turn] = []
        self.rendered = template([])
        if self.alone and self.rendered:
            raise ValueError("turns that stand alone need an empty rendering of no turns")
        self._edges: dict[str, tuple[int, int]] = {}

    def add(self, role: str, text: str) -> tuple[str, int, int] | None:
        """What the turn adds to the rendering and where its text begins and ends in that; None if it rewrites history."""
        if self.alone and len(self.turns) == WINDOW:
            self.turns, self.rendered = [], ""
        before = self.rendered
        edges = self._around(role, before)
        self.turns.append((role, text))
        self.rendered = self.template(self.turns)
        if edges is None or not self.rendered.startswith(before):
            return None
        added = self.rendered[len(before) :]
        return added, edges[0], len(added) - edges[1]

    def _around(self, role: str, before: str) -> tuple[int, int] | None:
        """Characters of the turn's span before its text and after it, from two texts that differ in one character."""
        if self.alone and role in self._edges:
            return self._edges[role]
        one, other = (self.template([*self.turns, (role, x)]) for x in "01")
        if not one.startswith(before) or not other.startswith(before):
            return None
        at = next((k for k, (x, y) in enumerate(zip(one, other)) if x != y), None)
        if at is None or at < len(before) or one[at + 1 :] != other[at + 1 :]:
            return None
        self._edges[role] = at - len(before), len(one) - at - 1
        return self._edges[role]


class _Row:
    """A row of the output while it grows."""

    def __init__(self, conv, first: bool):
        self.conv, self.first, self.n, self.rewrites = conv, first, 0, 0
        self.text: list[str] = []
        self.turns: list[dict] = []
        self.mask: list[dict] = []
        self.size = 0

    def add(self, prefixes: Prefixes, role: str, text: str, learned: str) -> None:
        found = prefixes.add(role, text)
        self.n += 1
        if found is None:
            if prefixes.alone:
                raise ValueError("a template whose turns stand alone rewrote one")
            self.rewrites += 1
        if found is None or self.rewrites:
            # what was said of earlier renderings doesn't hold for this one
            self.text, self.turns, self.mask, self.size = [prefixes.rendered], [], [], len(prefixes.rendered)
            return
        added, a, b = found
        self.text.append(added)
        self.turns.append({"start": self.size, "stop": self.size + len(added)})
        if role == learned:
            self.mask.append({"start": self.size + a, "stop": self.size + b})
        self.size += len(added)


def rendered(conversations: DataFrame, template: Callable[[list[Turn]], str] | None = None, learned: str = "assistant", row_chars: int = ROW_CHARS) -> DataFrame:
    """Rows of ``SCHEMA``; to be written as Parquet and read by ``part`` and ``place``.

    ``first`` and ``last`` are true where the task that made the row saw the conversation begin and end there:
    a row with both is surely whole.
    """
    template = template or Marked()
    spark = conversations.sparkSession
    bounded_batches(spark)
    alone = getattr(template, "alone", False)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, parts = rows.withColumn("tie", F.md5("text")), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if alone:
        # also the turns of one conversation, and equal turns, are dealt over several ranges
        rows = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(parts, "conv_id", "turn", "role", "tie", "copy").sortWithinPartitions("conv_id", "turn", "role", "tie", "copy")
    else:
        rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, row, held, chars = TaskContext.get().partitionId(), 0, None, [], 0
        edge = alone  # the first conversation of a range may have begun in the one before

        def ended(last: bool) -> None:
            nonlocal place, chars
            held.append({"part": part, "place": place, "conv_id": row.conv, "first": row.first, "last": last, "n_turns": row.n, "rewrites": row.rewrites, "text": "".join(row.text), "turns": row.turns, "mask": row.mask})
            place, chars = place + 1, chars + row.size

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=_arrow(kinds))

        kinds = None
        for batch in batches:
            kinds = batch.schema.field(0).type
            convs, roles, texts = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for conv, role, text in zip(convs, roles, texts):
                if row is None or row.conv != conv:
                    if row is not None:
                        ended(True)
                        edge = False
                    row, prefixes = _Row(conv, not edge), Prefixes(template)
                elif alone and row.size >= row_chars:
                    ended(False)
                    row = _Row(conv, False)
                row.add(prefixes, role, text, learned)
                if chars >= row_chars or len(held) >= 4096:
                    yield batch_of(held)
                    held.clear()
                    chars = 0
        if row is not None:
            # the last one of a range may go on in the next
            ended(not alone)
            yield batch_of(held)

    return rows.mapInArrow(K.lean(run), SCHEMA.format(id=kind))


def _arrow(conv: pa.DataType) -> pa.Schema:
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    return pa.schema([("part", pa.int32()), ("place", pa.int64()), ("conv_id", conv), ("first", pa.bool_()), ("last", pa.bool_()), ("n_turns", pa.int64()), ("rewrites", pa.int64()), ("text", pa.string()), ("turns", spans), ("mask", spans)])


def write(conversations: DataFrame, path: str, template: Callable[[list[Turn]], str] | None = None, learned: str = "assistant", row_chars: int = ROW_CHARS) -> None:
    rendered(conversations, template, learned, row_chars).write.option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    """Rows of a formatted output; the rows of a conversation in order of (part, place)."""
    return spark.read.parquet(path)


class _Digest:
    """Running digests of a conversation's rows."""

    def __init__(self, conv):
        self.conv, self.n, self.chars, self.loss = conv, 0, 0, 0
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, template: Marked, text: str, mask: list[dict]) -> None:
        for role, said in template.read(text):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for span in mask:
            said = template.unescape(text[span["start"] : span["stop"]])
            self.loss += len(said)
            self.learned.update(said.encode())
        self.chars += len(text)

    def row(self) -> dict:
        return {"conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss, "loss_sha256": self.learned.hexdigest(), "formatted_chars": self.chars}


def digest(formatted: DataFrame, template: Marked | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from an output of ``template``.

    Rows that are whole conversations are digested where they lie; only the others are brought together and
    hashed in order, a row at a time: a SHA-256 is one sequence, however long the conversation.
    """
    template = template or Marked()
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema = None, None
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            out = []
            for conv, whole, text, mask in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and (whole or now.conv != conv):
                    out.append(now.row())
                    now = None
                now = now or _Digest(conv)
                now.add(template, text, mask)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=schema)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    whole = F.col("first") & F.col("last")
    there = formatted.where(whole).select("conv_id", whole.alias("whole"), "text", "mask")
    pieces = formatted.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", whole.alias("whole"), "text", "mask")
    return there.mapInArrow(K.lean(run), schema).unionByName(pieces.mapInArrow(K.lean(run), schema))
