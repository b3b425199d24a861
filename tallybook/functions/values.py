"""Typed values out of statement text, and exact sums over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: month words, and two-digit years, which stand for 1976 to 2075.
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH_WORD = (
    r"(?=(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    r"sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z]))([a-z]{3})[a-z]*\.?"
)
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}$"
_TIME = r"[ t]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?: ?[ap]m)?(?: ?(?:z|utc|gmt|[-+]\d{2}(?::?\d{2})?))?$"
_WEEKDAY = r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? +(?=\S)"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
_NUMERIC = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$"
_DAY_MONTH = r"^(\d{1,2})(?:st|nd|rd|th)?[-/. ]*" + _MONTH_WORD + r"[-/., ]*(\d{4}|\d{2})$"
_YEAR_MONTH = r"^(\d{4})[-/., ]+" + _MONTH_WORD + r"[-/., ]*(\d{1,2})(?:st|nd|rd|th)?$"
_MONTH_DAY = r"^" + _MONTH_WORD + r"[-/. ]*(\d{1,2})(?:st|nd|rd|th)?[-/., ]+(\d{4}|\d{2})$"


# All characters that count as white space at the ends of a text.
_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Amounts from here on are no money; they could not be added up exactly.
LARGEST = 1e24


def stripped(text: Column) -> Column:
    """The text without white space of any kind at both ends."""
    return F.btrim(text, F.lit(_SPACE))


def _as_day(ymd: Column) -> Column:
    """``y-m-d`` text with a year of two or four digits to a date, all else to null."""
    full = F.regexp_replace(ymd, r"^(7[6-9]|[89]\d)-", "19$1-")
    full = F.regexp_replace(full, r"^(\d{2})-", "20$1-")
    return F.regexp_extract(full, _ISO, 0).try_cast("date")


def parse_date(value: Column) -> Column:
    """Statement date text to ``date``; null when it is not a complete date.

    Understood, each with an optional time of day: ``2026-01-31`` (also ``/``, ``.``),
    ``01/31/2026`` with month first and day first as fallback, ``31 Jan 2026``,
    ``31-Jan-26``, ``Jan 31, 2026``, ``2026 Jan 31``, ``20260131`` and the full month
    names, after a weekday and before a time with or without a zone.

    Each form is rewritten to ISO by one pattern, which leaves other forms alone; that
    needs no formatter and throws nothing on bad rows.  ISO text takes a short path.
    """
    raw = value.cast("string")
    text = F.regexp_replace(F.regexp_replace(F.lower(stripped(raw)), _TIME, ""), _WEEKDAY, "")
    ymd = F.regexp_replace(text, _YEAR_FIRST, "$1-$2-$3")
    ymd = F.regexp_replace(ymd, _COMPACT, "$1-$2-$3")
    ymd = F.regexp_replace(ymd, _YEAR_MONTH, "$1-$2-$3")
    ymd = F.regexp_replace(ymd, _NUMERIC, "$3-$1-$2")
    ymd = F.regexp_replace(ymd, _DAY_MONTH, "$3-$2-$1")
    ymd = F.regexp_replace(ymd, _MONTH_DAY, "$3-$1-$2")
    for number, word in enumerate(_MONTHS, 1):
        ymd = F.replace(ymd, F.lit(f"-{word}-"), F.lit(f"-{number}-"))
    day_first = F.regexp_replace(text, _NUMERIC, "$3-$2-$1")
    return F.when(F.rlike(raw, F.lit(_ISO)), raw.try_cast("date")).otherwise(
        F.coalesce(_as_day(ymd), _as_day(day_first))
    )


def _number(text: Column) -> Column:
    value = F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")
    return F.when(F.abs(value) < LARGEST, value)


def parse_amount(value: Column) -> Column:
    """Amount text to ``double``: symbols and commas go, ``(50.00)`` is negative.

    Numbers too large for money are null like other unreadable text.
    """
    signed = F.replace(F.replace(stripped(value), F.lit("("), F.lit("-")), F.lit(")"), F.lit(""))
    return _number(signed)


def parse_side(value: Column) -> Column:
    """One side of a split debit/credit pair; anything unreadable counts as 0."""
    return F.coalesce(_number(value), F.lit(0.0))


def micros_text(amount: Column) -> Column:
    """The amount in millionths as text; amounts beyond a ``bigint`` of them as they are."""
    small = F.abs(amount) < 9e12
    return F.when(small, F.rint(F.when(small, amount) * 1_000_000).cast("bigint").cast("string")).otherwise(amount.cast("string"))


#: Limbs of 20 bits of a sum: 1e24 in millionths has 100 bits.
LIMBS = 5


def exact_total(amount: Column) -> Column:
    """Sum as ``decimal(38,6)`` that does not depend on the order of the rows.

    The millionths are split into limbs of 20 bits, each step exact in floating point, and
    added as five ``bigint`` sums, so that the partial aggregation stays in generated code
    with fixed-width buffers (a decimal sum of this width does not).  Amounts up to
    ``LARGEST`` fit; non-finite ones count as null.  A limb's sum holds 8e12 rows, so only a
    total beyond 1e32 does not fit.
    """
    value = F.rint(F.when(F.abs(amount) < LARGEST, amount) * 1_000_000)
    size, sign = F.abs(value), F.signum(value).cast("bigint")
    limb = float(1 << 20)
    # The remainder by a power of two and the quotient are exact.
    limbs = [F.floor((size % limb ** (k + 1) if k < LIMBS - 1 else size) / limb**k) for k in reversed(range(LIMBS))]
    sums = [F.sum(x * sign).cast("decimal(19,0)") for x in limbs]
    scale = F.lit(1 << 20).cast("decimal(7,0)")
    high = sums[0].cast("decimal(32,0)")
    for low in sums[1:-1]:
        high = (high * scale).cast("decimal(32,0)") + low
        high = high.cast("decimal(32,0)")
    # A limb's unit and a millionth, as amounts.
    unit, least = F.lit("1.048576").cast("decimal(7,6)"), F.lit("0.000001").cast("decimal(6,6)")
    return ((high * unit).cast("decimal(38,6)") + (sums[-1] * least).cast("decimal(25,6)")).cast("decimal(38,6)")


def cents(total: Column) -> Column:
    """A decimal total as ``double`` rounded to cents."""
    return F.round(total, 2).cast("double")


def exact_sum(amount: Column) -> Column:
    """:func:`exact_total` rounded to cents."""
    return cents(exact_total(amount))
