"""Row numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tallybook.session import materialize


def _begins(columns: list[pa.Array]) -> np.ndarray:
    """Where a row's values differ from those of the row before (the first row: true)."""
    out = np.zeros(len(columns[0]), bool)
    out[0] = True
    for column in columns:
        codes = np.asarray(column.dictionary_encode(null_encoding="encode").indices)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """``row_number`` over ``group`` in ``order`` without one task per group.

    ``group`` plus ``order`` must identify a row.  The rows move once: they are range-partitioned
    on both, so a large group spans many tasks, and numbered while their slice is written to the
    shared folder.  Only the first group of a slice can have begun in an earlier one, so what is
    added to its numbers is one row a slice at most, which every task can hold.
    """
    place, piece = f"_{name}", "_slice"
    at = [df.columns.index(c) for c in group]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            begins = _begins([batch.column(i) for i in at])
            begins[0] = last is None or [batch.column(i)[0].as_py() for i in at] != last
            starts = np.flatnonzero(begins)
            since = np.maximum.accumulate(np.where(begins, np.arange(n), -1 - count))  # before the first start: the rows so far
            places = np.arange(n) - np.where(since < 0, -count, since) + 1
            count = int(places[-1])
            last = [batch.column(i)[n - 1].as_py() for i in at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places), pa.array(np.full(n, own, np.int32))], names=[*batch.schema.names, place, piece])

    schema = StructType(list(df.schema.fields)).add(place, LongType()).add(piece, IntegerType())
    sliced = materialize(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).mapInArrow(work, schema))
    held = sliced.groupBy(*group, piece).agg(F.max(place).alias("_held"))
    earlier = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    begun = held.withColumn("_before", F.sum("_held").over(earlier)).where("_before > 0")
    begun = begun.select(*[F.col(c).alias(f"_group{i}") for i, c in enumerate(group)], F.col(piece).alias("_in"), "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_group{i}")) for i, c in enumerate(group)], F.col(piece) == F.col("_in"))
    return sliced.join(F.broadcast(begun), same, "left").select(
        *df.columns, (F.col(place) + F.coalesce("_before", F.lit(0))).alias(name))
