"""Conversation structure repair: one sorted stream of turns, the cheapest edits to legal roles.

Rows are dealt by conversation and sorted by turn; ``mapInPandas`` carries the state of the running conversation from one Arrow
batch to the next (``turn_edits``), so neither a batch nor a conversation has to fit into memory.  Back pointers of a giant
conversation are spilled to the shared folder in blocks.

Whether a row repeats an earlier one is known without remembering the rows: the first turn of every (conversation, role, text) is
found by a pre-aggregated grouping over checksums, and a slim mark with that turn is sorted just before the row it stands for.
Only the stream carries texts, once.  The checksum of a repaired conversation has to be computed in its order; that is why one
conversation stays one stream.

Faults of a row, the first that holds: ``blank`` (nothing but white space), ``duplicate`` (role and text seen earlier in the
conversation), ``truncated`` (the last visible character is none of ``.!?``).  Edits: keep a row for 0, give it the role user or
assistant for 1, delete it for 2, insert an empty user or assistant row for 5; a truncated row that stays adds 5; blank and
duplicate rows must go.  Role initials of the result are ``(s?(ua)+)?``; of equally cheap edit strings the ASCII-least is taken.

Defined cases: a null role or text is one space; a null conversation id is a conversation of its own; null turns come first and
count for no gap; rows of one turn are taken by role, then by MD5 of the text; repeated rows are duplicates; a gap number beyond 64
bits is the largest number; an empty role has no initial and is never kept; without rows the edit string is empty; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymark.llm.store import folder
from quarrymark.llm.turn_edits import SPILL, Repair, Steps, applied

SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
MARK, ROW, ABSENT, EDITS = 1, 2, 3, 0
LARGEST = 2**63 - 1
REPORT = (
    "none boolean, conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
REPAIRED = "none boolean, conv string, position long, timed boolean, turn long, role string, text string, edit string"


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults planted by checksum of ``conv_id:turn``; a dropped row stays as one that is not ``present``."""
    kind = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn"))) % 20
    text = _filled("text")
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(_filled("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"),
    )
    return rows.select("conv_id", "turn", "role", "text", "present", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def _stream(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Rows, marks and conversations without rows in one order; every partition holds whole conversations."""
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    end = F.rtrim(_filled("text"), F.lit(SPACE))
    facts = rows.select(
        F.col("conv_id").isNull().alias("none"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        (F.col("turn").isNotNull() & present).alias("timed"),
        F.when(present, F.coalesce(F.col("turn").cast("long"), F.lit(0))).otherwise(0).alias("turn"),
        F.when(present, _filled("role")).otherwise("").alias("role"),
        F.when(present, F.md5(_filled("text"))).otherwise("").alias("digest"),
        F.when(present, _filled("text")).otherwise("").alias("text"),
        F.when(present, F.lit(ROW)).otherwise(F.lit(ABSENT)).alias("kind"),
        (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    first = F.min(F.struct("timed", "turn")).alias("first")
    marks = facts.where(f"kind = {ROW} AND NOT blank").groupBy("none", "conv", "role", "digest").agg(first)
    slim = marks.select(
        "none", "conv", "first.timed", "first.turn", "role", "digest", F.lit("").alias("text"),
        F.lit(MARK).alias("kind"), F.lit(False).alias("blank"), F.lit(False).alias("cut"),
    )
    both = facts.unionByName(slim)
    both = both if more is None else both.unionByName(more)
    head = F.col("kind") == EDITS
    return both.repartition("none", "conv").sortWithinPartitions(
        "none", "conv", F.desc(head), "timed", "turn", "role", "digest", "kind"
    )


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for frame in frames:
        yield from zip(*(frame[c].tolist() for c in frame.columns), strict=True)


class _Running:
    """Counts and edits of the conversation in hand."""

    def __init__(self, key: tuple, steps: Steps, spill: str, block: int) -> None:
        self.key = key
        self.repair = Repair(steps, spill, block)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = self.mark = None

    def add(self, timed: bool, turn: int, role: str, digest: str, text: str, kind: int, blank: bool, cut: bool) -> None:
        if kind == ABSENT:
            return
        if kind == MARK:
            self.mark = (timed, turn, role, digest)
            return
        duplicate = not blank and self.mark != (timed, turn, role, digest)
        self.mark = None
        self.blank += blank
        self.duplicate += duplicate
        cut = cut and not blank and not duplicate
        self.truncated += cut
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL
        self.before = role[:1]
        if timed:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.repair.add(role, text, blank or duplicate, cut)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, LARGEST)
        cost, audit, digest = self.repair.result()
        return (*self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest)


def _frames(rows: Iterator[tuple], schema: str, most: int = 5000, letters: int = 32 << 20) -> Iterator[pd.DataFrame]:
    """Output frames of bounded length."""
    names = [part.split()[0] for part in schema.split(", ")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == most or size > letters:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def _reported(records: Iterator[tuple], spill: str, block: int) -> Iterator[tuple]:
    steps, running = Steps(), None
    for none, conv, *rest in records:
        if running is None or running.key != (none, conv):
            if running is not None:
                yield running.row()
            running = _Running((none, conv), steps, spill, block)
        running.add(*rest)
    if running is not None:
        yield running.row()


def report(rows: DataFrame, block: int = SPILL) -> DataFrame:
    """Faults, cheapest cost, edit string and checksum of every conversation.

    A boolean column ``present`` that is false marks a row that only names its conversation.
    """
    spill = folder(rows.sparkSession, "turn-steps")
    kind = rows.schema["conv_id"].dataType
    found = _stream(rows).mapInPandas(lambda f: _frames(_reported(_records(f), spill, block), REPORT), REPORT)
    conv = F.when(~F.col("none"), F.col("conv").cast(kind)).alias("conv_id")
    return found.select(conv, *[c for c in found.columns if c not in ("none", "conv")])


def _rewritten(records: Iterator[tuple]) -> Iterator[tuple]:
    """The edit string of a conversation is its first record; its rows follow in order."""
    waiting: list[tuple] = []

    def next_row() -> tuple:
        for record in chain(iter(waiting), records):
            if record[7] == ROW:
                return record[4], record
        raise ValueError("an edit string is longer than its conversation")

    for record in records:
        if record[7] != EDITS:
            continue
        none, conv, edits = record[0], record[1], record[6]
        for position, (edit, role, taken) in enumerate(applied(iter(edits), next_row)):
            row = taken[1] if taken else (none, conv, False, 0, role, "", "")
            yield none, conv, position, row[2], row[3], role or row[4], row[6], edit


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, edit): the conversations after their edits; inserted rows have no turn."""
    audits = report(rows).select(
        F.col("conv_id").isNull().alias("none"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.lit(False).alias("timed"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"),
        F.col("audit").alias("text"), F.lit(EDITS).alias("kind"), F.lit(False).alias("blank"), F.lit(False).alias("cut"),
    )
    kind = rows.schema["conv_id"].dataType
    found = _stream(rows, audits).mapInPandas(lambda f: _frames(_rewritten(_records(f)), REPAIRED), REPAIRED)
    return found.select(
        F.when(~F.col("none"), F.col("conv").cast(kind)).alias("conv_id"),
        "position",
        F.when(F.col("timed"), F.col("turn")).alias("turn"),
        "role",
        "text",
        "edit",
    )


def digests(conversations: DataFrame) -> DataFrame:
    """The report over damaged conversations."""
    return report(damaged(conversations))
