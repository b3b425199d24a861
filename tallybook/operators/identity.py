"""Row identity that does not depend on file or row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.values import exact_sum, micros_text

_COPIES_PER_TASK = 100_000


def numbered_copies(ledger: DataFrame) -> DataFrame:
    """Add ``_copy``: 1 and up among equal rows.

    Equal rows are counted first (partially before the shuffle, so a row that makes
    up a third of the ledger is one counter per task) and numbered while they are
    spread out again.  Long runs of copies are cut into pieces that many tasks take.
    """
    columns = ledger.columns
    counted = ledger.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    few = counted.where(F.col("_copies") <= _COPIES_PER_TASK).select(
        *columns, F.lit(1).cast("bigint").alias("_first"), F.col("_copies").alias("_last")
    )
    many = (
        counted.where(F.col("_copies") > _COPIES_PER_TASK)
        .select(
            *columns, "_copies",
            F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"),
                                 F.lit(_COPIES_PER_TASK).cast("bigint"))).alias("_first"),
        )
        .withColumn("_last", F.least(F.col("_first") + _COPIES_PER_TASK - 1, F.col("_copies")))
        .drop("_copies")
        .repartition(*columns, "_first")
    )
    return few.unionByName(many).select(*columns, F.explode(F.sequence("_first", "_last")).alias("_copy"))


def named_copies(copies: DataFrame) -> DataFrame:
    """``txn_id`` in the place of ``_copy``."""
    content = F.concat_ws(
        "|", F.col("date").cast("string"), F.col("description"), micros_text(F.col("amount"))
    )
    return copies.select(
        F.concat(F.lit("txn_"), F.md5(content), F.lit("-"), F.col("_copy").cast("string")).alias("txn_id"),
        *[c for c in copies.columns if c != "_copy"],
    )


def with_txn_id(ledger: DataFrame) -> DataFrame:
    """Add ``txn_id``: a hash of date, description and amount plus a copy number."""
    return named_copies(numbered_copies(ledger))


def _fingerprint() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_rows"),
        exact_sum(F.col("amount")).alias("amount_sum"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    ]


def ledger_fingerprint(ledger: DataFrame) -> DataFrame:
    """One row that changes when the ledger does; compare it before a rebuild."""
    return ledger.agg(*_fingerprint())


def month_fingerprints(ledger: DataFrame) -> DataFrame:
    """The fingerprint of each month (``year, month_num``), for :func:`changed_months`.

    ``content`` adds up a hash of each row, so that also changes show that keep the sums:
    another description or category, amounts that trade places, one copy more or less.
    """
    row = F.xxhash64(*[F.col(c) for c in sorted(ledger.columns)])
    return ledger.groupBy(F.year("date").alias("year"), F.month("date").alias("month_num")).agg(
        *_fingerprint(), F.sum(row.cast("decimal(20,0)")).cast("string").alias("content"))


def changed_months(stored: DataFrame, now: DataFrame) -> DataFrame:
    """``year, month_num, action`` of all months: added, changed, removed or kept."""
    keys = ["year", "month_num"]
    values = [c for c in now.columns if c not in keys]

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*values).alias(name))

    both = packed(stored, "old").join(packed(now, "new"), keys, "full")
    action = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(F.col("old").eqNullSafe(F.col("new")), "kept").otherwise("changed"))
    return both.select(*keys, action.alias("action"))
