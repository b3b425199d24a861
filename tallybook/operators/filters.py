"""Ledger filters, derived metadata and the sentence that describes a row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook import vocab


def filter_ledger(
    ledger: DataFrame,
    search: str | None = None,
    categories: Sequence[str] = (),
    transaction_type: str | None = None,
) -> DataFrame:
    """The view behind the transaction browser.

    ``search`` is a regular expression over the description, without regard to case.
    Order the result by ``date`` descending where it is shown.
    """
    if search:
        ledger = ledger.where(F.rlike("description", F.lit(f"(?iu){search}")))
    if categories:
        ledger = ledger.where(F.col("category").isin(*categories))
    if transaction_type:
        ledger = ledger.where(F.col("transaction_type") == transaction_type.lower())
    return ledger


def metadata_condition(
    categories: Sequence[str] = (),
    months: Sequence[str] = (),
    month_nums: Sequence[int] = (),
) -> Column | None:
    """Equality / membership conditions joined by AND, null when there are none.

    All of them are plain column comparisons, which reach the Parquet scan.  Months
    with a year take the place of bare month numbers.
    """
    tests = []
    if categories:
        tests.append(F.col("category").isin(*categories))
    if months:
        tests.append(F.col("month").isin(*months))
    elif month_nums:
        tests.append(F.col("month_num").isin(*month_nums))
    return reduce(lambda a, b: a & b, tests) if tests else None


def where_metadata(index: DataFrame, **conditions: Sequence) -> DataFrame:
    condition = metadata_condition(**conditions)
    return index if condition is None else index.where(condition)


def where_merchant(ledger: DataFrame, merchant: str) -> DataFrame:
    """Rows whose description contains ``merchant``, without regard to case.

    A stored ``description_lc`` column is used when there is one, because a test of
    a plain column reaches the Parquet scan and ``lower(description)`` does not.
    """
    stored = "description_lc" in ledger.columns
    text = F.col("description_lc") if stored else F.lower("description")
    return ledger.where(F.contains(text, F.lit(merchant.lower())))


def with_metadata(ledger: DataFrame) -> DataFrame:
    return ledger.withColumns({
        "month": F.date_format("date", "yyyy-MM"),
        "month_name": F.date_format("date", "MMMM yyyy"),
        "month_num": F.month("date"),
        "year": F.year("date"),
        "abs_amount": F.abs("amount"),
    })


def chunk_text() -> Column:
    """One sentence per transaction, the text that gets embedded."""
    return F.format_string(
        "%s transaction on %s: %s — " + vocab.CURRENCY + "%.2f. Type: %s.",
        F.col("category"),
        F.date_format("date", "EEEE, MMMM dd yyyy"),
        F.col("description"),
        F.abs("amount"),
        F.col("transaction_type"),
    )


def with_chunk(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("chunk", chunk_text())
