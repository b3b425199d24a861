"""Words and their hashes, shared by the operators that read texts."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = values + _PRIME
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number of words."""

    most = 1 << 20

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words count as one run, none as none."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = mixed(out ^ hashes[i : n - size + 1 + i])
    return out


def map_batches(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` under a shorter name."""
    return df.mapInArrow(work, schema)


def by_value(df: DataFrame, value: Any) -> Callable[[], Any]:
    """Broadcast an object with its class, so that executors need no copy of this package.

    ``SparkContext.broadcast`` names classes by their module, which workers would import.
    """
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(shared.value)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_of(doc_id: Column) -> Column:
    """CRC-32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
