"""Personal data: base patterns, plus disguised identifiers mapped back to the source text."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallybook.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:bigint,end:bigint,found:string>>"
Span = tuple[str, int, int]

# Patterns of the contract, written so that each runs in linear time.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = int(c) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind, then start.

    A pattern's matches are leftmost and don't overlap; those that fail their test are
    dropped without another try.  An address is found from its ``@``: the local part is all
    of its characters before it, back to the end of the last address.
    """
    out: list[Span] = []
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# FIXED VALUES: letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχ",
    "ABESIJKMHOPCTXYaesijopcxydhqwABEZHIKMNOPTYXaiknoptux", strict=True))
# FIXED VALUES: spelled digits.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
# FIXED VALUES: words for the signs; those that mean nothing else need no dot word after them.
_DOT, _PLUS, _AT_WORDS = "(?:dot|point|punkt|punto)", "(?:plus|más|mas)", "(?:arobase|arrobase|arroba|klammeraffe)"
#: Least number of neighbouring digits, one of them spelled, that are read as a number.
LEAST_SPELLED = 4

_WORD = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_GAP = r"[ \t]*[ \t,-][ \t]*"
_DOTTED = rf"(?:[ \t]+{_DOT}[ \t]+|[ \t]*[\(\[\{{][ \t]*{_DOT}[ \t]*[\)\]\}}][ \t]*)"
_SPELLED = re.compile(
    rf"\b(?:{_PLUS}[ \t]+)?{_WORD}(?:(?:{_GAP}|{_DOTTED}){_WORD}){{{LEAST_SPELLED - 1},}}\b", re.I)
_SPELLED_PART = re.compile(rf"({_WORD})\b|({_PLUS})|({_DOTTED})|({_GAP})", re.I)
# Spelled digits and numerals in one number, written without backtracking into blanks.
_UNIT = rf"(?:{_WORD}\b|[0-9]++)"
_BREAK = r"(?:[ \t]++(?:[,-][ \t]*+)?|[,-][ \t]*+)"
_POINT = rf"(?:[ \t]++{_DOT}[ \t]++|[ \t]*+[\(\[\{{][ \t]*+{_DOT}[ \t]*+[\)\]\}}][ \t]*+|\.)"
_MIXED = re.compile(rf"\b(?:{_PLUS}[ \t]++)?{_UNIT}(?>(?:{_POINT}|{_BREAK}){_UNIT})++(?![A-Za-z])", re.I)
_MIXED_PART = re.compile(rf"({_WORD})\b|({_PLUS})|({_POINT})|({_BREAK})|[0-9]++", re.I)
_BESIDE = re.compile(rf"\b{_WORD}(?:{_POINT}|{_BREAK})[0-9]|[0-9](?:{_POINT}|{_BREAK}){_WORD}\b")
_AT_SIGN = rf"[ \t]*[\(\[\{{<][ \t]*(?:at|@|{_AT_WORDS})[ \t]*[\)\]\}}>][ \t]*"
_DOT_SIGN = rf"[ \t]*[\(\[\{{<][ \t]*(?:{_DOT}|\.)[ \t]*[\)\]\}}>][ \t]*"
_DISGUISED = re.compile(
    rf"(?P<at>{_AT_SIGN}|(?<=[A-Za-z0-9])[ \t]+{_AT_WORDS}[ \t]+(?=[A-Za-z0-9]))"
    rf"|(?P<dot>{_DOT_SIGN}|(?<=[A-Za-z0-9])[ \t]+{_DOT}[ \t]+(?=[A-Za-z0-9]))"
    rf"|(?P<bare>(?<=[A-Za-z0-9])[ \t]+at[ \t]+(?=[A-Za-z0-9-]+(?:[ \t]+{_DOT}[ \t]+|[ \t]*[\(\[\{{<][ \t]*(?:{_DOT}|\.)[ \t]*[\)\]\}}>])))", re.I)
_ODD = re.compile("[" + "".join(_LOOKALIKES) + "­  -― ⁠−　﻿！-～٠-٩۰-۹०-९]")
_INVISIBLE = frozenset("­​‌‍‎‏⁠﻿")
#: Without one of these or an odd character a text has nothing to normalise.  They and
#: _BESIDE are for folded texts: patterns that ignore case are several times as slow.
_TRIGGER = re.compile(
    rf"[\(\[\{{<][ \t]*(?:at|{_DOT}|@|\.|{_AT_WORDS})[ \t]*[\)\]\}}>]|[ \t](?:dot|{_AT_WORDS})[ \t]"
    rf"|[ \t]at[ \t]+[A-Za-z0-9-]+[ \t]+{_DOT}[ \t]|\b{_WORD}{_GAP}{_WORD}\b")
_DOT_WORD = re.compile(rf"[ \t]{_DOT}[ \t]")


class Normalised:
    """A text and, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.sources, self.lengths = text, [0], [0], [0]

    def rewritten(self, changes: Iterator[tuple[int, int, str]]) -> Normalised:
        """Replace the given stretches; everything between them is copied."""
        out, parts, at, place = Normalised(""), [], 0, 0
        out.starts, out.sources, out.lengths = [], [], []

        def emit(piece: str, start: int, length: int) -> None:
            nonlocal place
            out.starts.append(place)
            out.sources.append(start)
            out.lengths.append(length)
            parts.append(piece)
            place += len(piece)

        for start, end, new in changes:
            if start > at:
                emit(self.text[at:start], at, 0)
            emit(new, start, end - start)
            at = end
        if at < len(self.text) or not parts:
            emit(self.text[at:], at, 0)
        out.text = "".join(parts)
        return out

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span, and whether anything inside was rewritten."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        # A piece of length 0 is a copy, all else stands for one stretch of the source.
        first = self.sources[i] + (0 if self.lengths[i] else start - self.starts[i])
        last = self.sources[j] + (self.lengths[j] or end - self.starts[j])
        return first, last, any(self.lengths[i : j + 1])


def _characters(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ODD.finditer(text):
        c = m[0]
        if c in _LOOKALIKES:
            new = _LOOKALIKES[c]
        elif c in _INVISIBLE:
            new = ""
        elif "！" <= c <= "～":
            new = chr(ord(c) - 0xFEE0)
        elif "‐" <= c <= "―" or c == "−":
            new = "-"
        else:
            digit = unicodedata.digit(c, None)
            new = " " if digit is None else str(digit)
        yield m.start(), m.end(), new


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    for run in _SPELLED.finditer(text):
        for m in _SPELLED_PART.finditer(text, run.start(), run.end()):
            if m[1]:
                yield m.start(), m.end(), _DIGIT_WORDS[m[1].lower()]
            else:
                yield m.start(), m.end(), "." if m[3] else ("+" if m[2] else "")


def _mixed(text: str) -> Iterator[tuple[int, int, str]]:
    """Numbers of spelled digits and numerals side by side."""
    for run in _MIXED.finditer(text):
        parts = list(_MIXED_PART.finditer(text, run.start(), run.end()))
        digits = [_DIGIT_WORDS[m[1].lower()] if m[1] else m[0] for m in parts if m.lastindex in (None, 1)]
        if sum(map(len, digits)) < LEAST_SPELLED or not any(m[1] for m in parts):
            continue
        for m in parts:
            if m[1]:
                yield m.start(), m.end(), _DIGIT_WORDS[m[1].lower()]
            elif m.lastindex:
                yield m.start(), m.end(), "." if m[3] else ("+" if m[2] else "")


def _signs(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _DISGUISED.finditer(text):
        yield m.start(), m.end(), "." if m["dot"] else "@"


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only show after normalising, as spans of the source text.

    Three transducers run one after the other: characters (look-alikes, full width, other
    digits, invisible ones), spelled digits, at and dot signs.  Where spelled digits stand
    beside numerals, the steps run again with both as one number.  A span that nothing was
    rewritten in, or that lies inside a base span or an earlier added one, is not added;
    wider ones stand beside the base spans.
    """
    characters = Normalised(text).rewritten(_characters(text))
    folded = characters.text.casefold()
    mixed = _BESIDE.search(folded)
    if not (mixed or characters.text != text or _TRIGGER.search(folded) or ("@" in text and _DOT_WORD.search(folded))):
        return []
    found = []
    for rules in (_spelled, _mixed) if mixed else (_spelled,):
        steps = [characters]
        for step in (rules, _signs):
            steps.append(steps[-1].rewritten(step(steps[-1].text)))
        for kind, first, last in base_spans(steps[-1].text):
            start, end, changed = first, last, False
            for step in reversed(steps):
                start, end, here = step.source(start, end)
                changed |= here
            while start < end and text[start] in " \t":
                start += 1
            while start < end and text[end - 1] in " \t":
                end -= 1
            if changed and start < end:
                found.append((kind, start, end))
    taken, out = [(s, e) for _, s, e in base], []
    for kind, start, end in found:
        if any(s <= start and end <= e for s, e in taken):
            continue
        out.append((kind, start, end))
        taken.append((start, end))
    return out


def spans_of(text: str | None) -> list[tuple[str, int, int, str]]:
    """All spans of a text (kind, start, end, found) by kind as listed, then start."""
    if not text:
        return []
    base = base_spans(text)
    rows = [(*s, "base") for s in base] + [(*s, "disguised") for s in disguised_spans(text, base)]
    return sorted(rows, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlaps become one."""
    if not text:
        return text
    parts, at = [], 0
    for kind, start, end, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) to ``doc_id, spans``; spans are in code points, end exclusive.

    Whole texts are read, whatever their length, in linear time.  A null or empty text has
    no spans; repeated rows give repeated results; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "found"), s, strict=True)) for s in spans_of(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {id_type}, spans {SPANS}")


def redact_pii(docs: DataFrame) -> DataFrame:
    """The same columns with each identifier in ``text`` replaced by ``[EMAIL]`` and so on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = pa.array([redacted(t) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), texts)

    return map_batches(docs, work, docs.schema)
