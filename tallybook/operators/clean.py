"""Raw statement rows to the clean ledger.

One projection and one filter per ledger: no shuffle, no Python, no sort (rows are
ordered only where somebody reads them).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook import vocab
from tallybook.functions.text import clean_description
from tallybook.functions.values import parse_amount, parse_date, parse_side, stripped
from tallybook.session import compiled_methods

LEDGER_COLUMNS = ["date", "description", "amount", "transaction_type"]
REJECT_REASONS = ["unreadable date", "unreadable amount", "zero amount", "blank description"]


class MissingColumns(ValueError):
    """A statement has no header for a required ledger column."""


def resolve_headers(columns: Sequence[str], aliases: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Map ``date``, ``description``, ``amount`` (or ``debit`` and ``credit``) to headers.

    Headers match without regard to case and outer blanks; the first alias in list
    order wins.  ``debit`` and ``credit`` make a split pair only when both are there
    and no other amount header is.
    """
    aliases = aliases or vocab.COLUMN_ALIASES
    named: dict[str, str] = {}
    for column in columns:
        named.setdefault(column.strip().lower(), column)
    single = [a for a in aliases["amount"] if a not in ("debit", "credit")]
    both_sides = "debit" in named and "credit" in named
    found: dict[str, str] = {}
    for target in ("date", "description"):
        found.update({target: named[a] for a in reversed(aliases[target]) if a in named})
    amount_names = [a for a in (single if both_sides else aliases["amount"]) if a in named]
    if amount_names:
        found["amount"] = named[amount_names[0]]
    elif both_sides:
        found["debit"], found["credit"] = named["debit"], named["credit"]
    missing = [c for c in ("date", "description") if c not in found]
    if "amount" not in found and "debit" not in found:
        missing.append("amount")
    if missing:
        raise MissingColumns(
            f"no header for {missing} among {list(columns)}; pass further aliases"
        )
    return found


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def normalize_columns(
    df: DataFrame,
    aliases: dict[str, list[str]] | None = None,
    keep: Sequence[str] = (),
    debit_only_negative: bool = False,
) -> DataFrame:
    """Rename to ``date, description, amount``, merge split sides, drop all else.

    A lone ``debit`` column is taken as a signed amount, as banks that export only
    one column mean it; ``debit_only_negative`` turns its sign instead.
    """
    found = resolve_headers(df.columns, aliases)
    if "amount" in found:
        amount = _quoted(found["amount"])
        if debit_only_negative and found["amount"].strip().lower() == "debit":
            amount = -_as_amount(df, found["amount"])
    else:
        amount = _as_side(df, found["credit"]) - _as_side(df, found["debit"])
    return df.select(
        _quoted(found["date"]).alias("date"),
        _quoted(found["description"]).alias("description"),
        amount.alias("amount"),
        *[_quoted(c) for c in keep],
    )


def _is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _as_amount(df: DataFrame, column: str) -> Column:
    value = _quoted(column)
    return value.cast("double") if _is_numeric(df, column) else parse_amount(value)


def _as_side(df: DataFrame, column: str) -> Column:
    value = _quoted(column)
    return F.coalesce(value.cast("double"), F.lit(0.0)) if _is_numeric(df, column) else parse_side(value)


def _as_date(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    typed = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return F.col(column).cast("date") if typed else parse_date(F.col(column))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` evaluated once, also when later filters use them.

    Catalyst moves a filter below a plain projection by repeating its expressions
    there, so parsing would run twice per row.  It does not move one below a
    generator.  A stage of such parsing is too long for one compiled method (see
    :func:`compiled_methods`).
    """
    compiled_methods(df.sparkSession)
    rest = [F.col(c) for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*rest, F.inline(F.array(row))).select(
        *df.columns, *[c for c in columns if c not in df.columns]
    )


def parse_dates(df: DataFrame) -> DataFrame:
    """``date`` as DATE; rows without a readable date are dropped."""
    return computed(df, date=_as_date(df, "date")).where(F.col("date").isNotNull())


def parse_amounts(df: DataFrame) -> DataFrame:
    """``amount`` as DOUBLE; rows without a readable amount are dropped."""
    return computed(df, amount=_as_amount(df, "amount")).where(F.col("amount").isNotNull())


def clean_descriptions(df: DataFrame) -> DataFrame:
    return df.withColumn("description", clean_description(F.col("description")))


def transaction_type(amount: Column) -> Column:
    return F.when(amount > 0, "credit").otherwise("debit")


def with_transaction_type(df: DataFrame) -> DataFrame:
    return df.withColumn("transaction_type", transaction_type(F.col("amount")))


def drop_non_transactions(df: DataFrame) -> DataFrame:
    """Without zero amounts and blank descriptions."""
    return df.where((F.col("amount") != 0) & (stripped(F.col("description")) != ""))


def clean_ledger(
    raw: DataFrame, aliases: dict[str, list[str]] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """The whole chain: ``date, description, amount, transaction_type`` (+ ``keep``)."""
    return (
        _parsed(normalize_columns(raw, aliases, keep))
        .where(F.col("date").isNotNull() & F.col("amount").isNotNull())
        .transform(with_transaction_type)
        .transform(drop_non_transactions)
        .select(*LEDGER_COLUMNS, *keep)
    )


def _parsed(df: DataFrame) -> DataFrame:
    return computed(
        df,
        date=_as_date(df, "date"),
        amount=_as_amount(df, "amount"),
        description=clean_description(F.col("description")),
    )


def with_reject_reason(
    raw: DataFrame, aliases: dict[str, list[str]] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Parsed columns plus why a row is not in the clean ledger (null: it is)."""
    parsed = _parsed(normalize_columns(raw, aliases, keep))
    unreadable_date, unreadable_amount, zero, no_description = REJECT_REASONS
    blank = F.col("description").isNull() | (F.col("description") == "")
    return parsed.withColumn(
        "reason",
        F.when(F.col("date").isNull(), unreadable_date)
        .when(F.col("amount").isNull(), unreadable_amount)
        .when(F.col("amount") == 0, zero)
        .when(blank, no_description),
    )


def clean_rejects(raw: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows lost per reason, in one pass."""
    return (
        with_reject_reason(raw, aliases)
        .where(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def clean_ledger_observed(
    raw: DataFrame, aliases: dict[str, list[str]] | None = None, keep: Sequence[str] = ()
) -> tuple[DataFrame, Observation]:
    """The clean ledger, and what its first action counts on the way: no second pass.

    The observation holds the rows lost per reason, ``kept`` and ``rows`` (all of them) once an
    action such as a write has run the whole ledger; reading it before waits for that action.
    Cleaning has no shuffle, so when the action is the write itself the counting tasks are those
    of its last stage: a task that is run again counts once.  An empty table counts zeros.
    """
    seen = Observation("cleaning")
    judged = with_reject_reason(raw, aliases, keep)
    counts = [F.count_if(F.col("reason") == reason).alias(reason) for reason in REJECT_REASONS]
    kept = F.col("reason").isNull()
    observed = judged.observe(seen, *counts, F.count_if(kept).alias("kept"), F.count(F.lit(1)).alias("rows"))
    ledger = observed.where(kept).transform(with_transaction_type)
    return ledger.select(*LEDGER_COLUMNS, *keep), seen
