"""Text expressions: cleaning, literal word lists, amounts inside free text."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_GAP = "\u0001 "
_WORD_START = r"(?<![\p{Lu}\p{Ll}\p{Lt}])(?=[\p{Lu}\p{Ll}\p{Lt}])"
_SPACES = r"(?U)[\s\x1c-\x1f]+"
RUPEE_AMOUNT = r"₹\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"


def regex_quote(text: str) -> str:
    """Quote ``text`` for Java regular expressions."""
    return re.sub(r"([\\.\[\]{}()*+?^$|#&\-])", r"\\\1", text)


def collapse_spaces(text: Column) -> Column:
    """Trim and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def title_case(text: Column) -> Column:
    """Upper-case the letter after every non-letter, lower-case all others.

    ``initcap`` only looks at blanks, so a marker and a blank go before each word
    start (``amazon.in`` has two) and out again afterwards.
    """
    marked = F.regexp_replace(F.lower(text), _WORD_START, _GAP)
    return F.regexp_replace(F.initcap(marked), _GAP, "")


def clean_description(text: Column) -> Column:
    return title_case(collapse_spaces(text))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when one of ``words`` occurs anywhere in ``text``."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def whole_words(words: Iterable[str]) -> str:
    """Regex that matches one of ``words`` between word boundaries (all scripts)."""
    return r"(?U)\b(?:" + "|".join(regex_quote(w) for w in words) + r")\b"


def contains_word(text: Column, words: Iterable[str]) -> Column:
    return F.rlike(text, F.lit(whole_words(words)))


def longest_word(text: Column, words: list[str]) -> Column:
    """The longest of ``words`` that occurs as a whole word in ``text``, else null.

    Ties go to the earlier word.  The look-ahead tries every start position, so
    overlapping words are all seen in one pass over the text.
    """
    ordered = sorted(words, key=len, reverse=True)
    pattern = r"(?U)(?=\b(" + "|".join(regex_quote(w) for w in ordered) + r")\b)"
    ranking = F.array(*[F.lit(w) for w in ordered])
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    best = F.array_min(F.transform(hits, lambda hit: F.array_position(ranking, hit)))
    return F.when(best.isNotNull(), F.try_element_at(ranking, best.cast("int")))


def rupee_amounts(text: Column) -> Column:
    """All amounts written after a rupee sign, in order, as ``array<double>``."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUPEE_AMOUNT), F.lit(1))
    return F.transform(found, lambda a: F.replace(a, F.lit(","), F.lit("")).cast("double"))


def answer_total(text: Column) -> Column:
    """The one total an answer text states, else null.

    The first amount on the first ``**answer`` line that has one, otherwise the
    largest amount of the whole text.
    """
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    firsts = F.transform(
        F.filter(lines, lambda line: F.lower(F.trim(F.regexp_replace(line, _SPACES, " "))).startswith("**answer")),
        lambda line: F.try_element_at(rupee_amounts(line), F.lit(1)),
    )
    stated = F.try_element_at(F.filter(firsts, lambda amount: amount.isNotNull()), F.lit(1))
    return F.coalesce(stated, F.array_max(rupee_amounts(text)))


def money(amount: Column) -> Column:
    """``1234.5`` as ``₹1,234.50``."""
    return F.format_string("₹%,.2f", amount.cast("double"))
