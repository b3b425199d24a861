"""Which words of a list occur inside a text, for lists of any length.

All words are matched in one pass by an Aho-Corasick automaton in a vectorized UDF:
built once per task, run once per distinct text of an Arrow batch.  Chains of
built-in ``contains`` calls give the same results, but one per word: for 200 words
they are several times slower and too long for one compiled method (see README).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _finder(words: Sequence[str]) -> Callable[[str], list[int]]:
    """A function from a text to the sorted places of the words it contains."""
    lowered = [w.lower() for w in words]
    import ahocorasick  # in the worker, which needs the package

    places: dict[str, list[int]] = {}
    for place, word in enumerate(lowered):
        places.setdefault(word, []).append(place)
    automaton = ahocorasick.Automaton()
    for word, numbers in places.items():
        automaton.add_word(word, numbers)
    automaton.make_automaton()
    return lambda text: sorted({n for _, numbers in automaton.iter(text) for n in numbers})


def _per_distinct(texts: pd.Series, value: Callable[[str], object], missing: object) -> pd.Series:
    codes, distinct = pd.factorize(texts)
    values = np.empty(len(distinct) + 1, dtype=object)
    for i, text in enumerate(distinct):
        values[i] = value(text.lower())
    values[-1] = missing
    return pd.Series(values[codes], index=texts.index)


def first_group(text: Column, groups: Mapping[str, Sequence[str]], otherwise: str) -> Column:
    """The first group (in mapping order) with a word inside ``text``, in any case."""
    words = [w for group in groups.values() for w in group]
    names = [name for name, group in groups.items() for _ in group]

    @F.pandas_udf("string")
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _finder(words)

        def name(value: str) -> str:
            hits = find(value)
            return names[hits[0]] if hits else otherwise

        for texts in batches:
            yield _per_distinct(texts, name, otherwise)

    return first(text)


def words_inside(text: Column, words: Sequence[str]) -> Column:
    """Places (0-based, ascending) of all ``words`` that occur in ``text``, in any case."""
    listed = list(words)

    @F.pandas_udf("array<int>")
    def inside(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _finder(listed)
        for texts in batches:
            yield _per_distinct(texts, find, [])

    return inside(text)


_ASCII_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def word_finder(whole: Sequence[Sequence[str]], inside: Sequence[Sequence[str]]) -> Callable[[str], tuple[list[set[int]], list[bool], bool]]:
    """A function from a text to its words, found in one pass; upper and lower case differ.

    It gives the places of each ``whole`` group's words that stand alone, whether a word of each
    ``inside`` group occurs anywhere, and whether the first is sure.  It is not when a word
    touches a character beyond ASCII: whether that is part of a word is left to the caller.
    """
    import ahocorasick  # in the worker, which needs the package

    uses: dict[str, list[tuple[bool, int, int]]] = {}
    for alone, groups in ((True, whole), (False, inside)):
        for group, words in enumerate(groups):
            for place, word in enumerate(words):
                uses.setdefault(word, []).append((alone, group, place))
    blank = uses.pop("", [])  # an empty word is everywhere; whether it stands alone is not judged here
    automaton = ahocorasick.Automaton()
    for word, used in uses.items():
        automaton.add_word(word, (len(word), word[0], word[-1], used))
    automaton.make_automaton()

    def find(text: str) -> tuple[list[set[int]], list[bool], bool]:
        places, held, sure = [set() for _ in whole], [False] * len(inside), True
        for alone, group, _ in blank:
            if alone:
                sure = False
            else:
                held[group] = True
        for end, (size, first, last, used) in automaton.iter(text) if uses else ():
            apart = None
            for alone, group, place in used:
                if not alone:
                    held[group] = True
                    continue
                if apart is None:
                    before, after = text[end - size] if end >= size else " ", text[end + 1] if end + 1 < len(text) else " "
                    known = all(c.isascii() for c in (before, first, last, after))
                    sure &= known
                    apart = known and (before in _ASCII_WORD) != (first in _ASCII_WORD) and (last in _ASCII_WORD) != (after in _ASCII_WORD)
                if apart:
                    places[group].add(place)
        return places, held, sure

    return find
