"""Chat formatting: turns to text segments with loss flags, by DataFrame functions alone."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    """The strings around a turn's text, and whether that text is trained on."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """How each role is written and which role may follow which.

    The machine's state is the last role that was read; ``moves`` maps a state to the
    roles it accepts, ``start`` is the state before the first turn, ``final`` lists the
    states a whole conversation may end in.  ``other`` holds the three strings around the
    name and the text of a role that ``roles`` doesn't know.
    """

    roles: dict[str, Marks] = field(default_factory=lambda: {
        "system": Marks("[SYS]", "[/SYS]"),
        "user": Marks("[INST]", "[/INST]"),
        "assistant": Marks("[ANS]", "</s>", loss=True),
    })
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    start: str = "(start)"
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "(start)": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    final: tuple[str, ...] = ("user", "assistant")

    def controls(self) -> list[str]:
        """All control strings, each once."""
        marks = [s for m in self.roles.values() for s in (m.before, m.after)]
        return list(dict.fromkeys([*marks, *self.other]))

    def check(self) -> None:
        """Raise unless escaped texts can't form a control string with what is beside them."""
        for c in self.controls():
            if len(c) < 2 or "\\" in c or any(c != d and d in c for d in self.controls()):
                raise ValueError(f"control string {c!r} is too short, has a backslash or holds another")
            if any(d[0] in c[1:] for d in self.controls()):
                raise ValueError(f"{c!r} holds the first character of a control string inside")


def escaped(text: Column, template: Template) -> Column:
    """A backslash after each backslash and after the first character of each control string."""
    heads: dict[str, list[str]] = {}
    for c in template.controls():
        heads.setdefault(c[0], []).append(re.escape(c[1:]))
    parts = [r"\\", *(f"{re.escape(h)}(?={'|'.join(rests)})" for h, rests in heads.items())]
    return F.regexp_replace(text, "|".join(parts), r"$0\\")


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`."""
    return F.regexp_replace(text, r"(?s)(.)\\", r"$1")


def format_segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Conversations (conv_id, turn, role, text) to segments in three parts per turn.

    Returns ``conv_id, turn_no`` (from 1), ``part`` (0 opening mark, 1 text, 2 closing
    mark), ``text``, ``loss``, ``turn_valid`` (the machine accepted the turn after the role
    before it) and ``role``.  Turns are read by ``turn`` (null last), ties by role and text;
    a null text or role counts as empty, a null conv_id is a conversation of its own.
    Repeated rows are turns like any other.  Nothing is left out: invalid turns are flagged.
    Other columns are ignored.
    """
    template.check()
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    allowed = F.lit(False)
    for state, roles in template.moves.items():
        allowed = F.when(F.col("state") == state, F.col("role").isin(*roles)).otherwise(allowed)
    rows = rows.select(
        "*", F.row_number().over(order).cast("bigint").alias("turn_no"),
        F.coalesce(F.lag("role").over(order), F.lit(template.start)).alias("state"))
    before = F.concat(F.lit(template.other[0]), escaped(F.col("role"), template), F.lit(template.other[1]))
    after, loss = F.lit(template.other[2]), F.lit(False)
    for role, marks in template.roles.items():
        known = F.col("role") == role
        before = F.when(known, F.lit(marks.before)).otherwise(before)
        after = F.when(known, F.lit(marks.after)).otherwise(after)
        loss = F.when(known, F.lit(marks.loss)).otherwise(loss)
    piece = lambda n, text, flag: F.struct(F.lit(n).alias("part"), text.alias("text"), flag.alias("loss"))
    pieces = F.array(piece(0, before, F.lit(False)), piece(1, escaped(F.col("text"), template), loss), piece(2, after, F.lit(False)))
    return rows.select("conv_id", "turn_no", "role", allowed.alias("turn_valid"), F.inline(pieces))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    ends = [*(m.after for m in template.roles.values()), template.other[2]]
    turns = F.filter(F.split(formatted, f"(?<={'|'.join(map(re.escape, ends))})"), lambda t: t != "")
    name, text, end = template.other

    def parsed(turn: Column) -> Column:
        middle = F.instr(turn, text)
        start = middle + len(text)
        out = F.struct(
            unescaped(F.substring(turn, F.lit(len(name) + 1), middle - 1 - len(name))).alias("role"),
            unescaped(F.substring(turn, start, F.char_length(turn) - len(end) - start + 1)).alias("text"))
        for role, marks in template.roles.items():
            inner = F.char_length(turn) - len(marks.before) - len(marks.after)
            out = F.when(turn.startswith(marks.before), F.struct(
                F.lit(role).alias("role"),
                unescaped(F.substring(turn, F.lit(len(marks.before) + 1), inner)).alias("text"))).otherwise(out)
        return out

    return F.transform(turns, parsed)


def conversations_out(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments to one row a conversation: formatted text, loss text, validity.

    A conversation's text is one value, so it is put together in one task; all else of
    this module works on single turns.
    """
    parts = F.array_sort(F.collect_list(F.struct("turn_no", "part", "text", "loss")))
    last = F.max_by("role", "turn_no")
    rows = segments.groupBy("conv_id").agg(
        parts.alias("parts"), F.bool_and("turn_valid").alias("moves_valid"), last.alias("last_role"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"),
        F.array_join(F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: unescaped(p["text"])), "").alias("loss_text"),
        (F.col("moves_valid") & F.col("last_role").isin(*template.final)).alias("valid"))
