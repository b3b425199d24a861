"""Spending reports.

Most of them read :func:`monthly_base`, one row per month, category and sign with
exact decimal totals.  A job that writes several reports computes it once, so the
ledger is scanned once and the only shuffle carries partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook import vocab
from tallybook.functions.values import cents, exact_sum, exact_total


def monthly_base(categorized: DataFrame) -> DataFrame:
    amount = F.col("amount")
    return categorized.groupBy(F.trunc("date", "MM").alias("month"), "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(amount > 0).alias("n_credits"),
        F.count_if(amount < 0).alias("n_debits"),
        F.coalesce(exact_total(F.when(amount > 0, amount)), _zero()).alias("income"),
        F.coalesce(exact_total(F.when(amount < 0, -amount)), _zero()).alias("spent"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def _zero() -> Column:
    return F.lit(0).cast("decimal(38,6)")


def _sum(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(28,6)"))


def category_summary(base: DataFrame) -> DataFrame:
    """Total, count and share of spending per category.

    ``Income`` and ``Savings/Transfer`` are no part of the spending base, which is
    the net sum of all other categories; shares exist for negative totals only.
    """
    per_category = base.groupBy("category").agg(
        (_sum("income") - _sum("spent")).alias("total"), F.sum("n").alias("txn_count")
    )
    counts = ~F.col("category").isin(*vocab.NON_SPENDING)
    spending = F.abs(F.sum(F.when(counts, F.col("total"))).over(Window.partitionBy()))
    share = F.when(
        counts & (F.col("total") < 0) & (spending > 0),
        F.abs(F.col("total").cast("double")) / spending.cast("double") * 100,
    )
    return per_category.select(
        "category",
        cents(F.col("total")).alias("total_amount"),
        "txn_count",
        F.round(share, 1).alias("pct"),
        F.coalesce(F.format_string("%.1f%%", F.round(share, 1)), F.lit("—")).alias("pct_of_spending"),
    ).withColumn(
        "pct_of_spending", F.when(F.col("pct").isNull(), "—").otherwise(F.col("pct_of_spending"))
    )


def statement_summary(base: DataFrame) -> DataFrame:
    return base.agg(
        F.sum("n").alias("n_transactions"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.sum("n_credits").alias("n_credits"),
        cents(_sum("income")).alias("total_credits"),
        F.sum("n_debits").alias("n_debits"),
        cents(_sum("spent")).alias("total_debits"),
        cents(_sum("income") - _sum("spent")).alias("net"),
    )


def monthly_breakdown(base: DataFrame) -> DataFrame:
    return base.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(
        F.sum("n").alias("transactions"),
        cents(_sum("income") - _sum("spent")).alias("net_flow"),
        cents(_sum("spent")).alias("total_spent"),
        cents(_sum("income")).alias("total_income"),
    )


def kpi_cards(base: DataFrame) -> DataFrame:
    """Income, spending, net and average spending per month with transactions."""
    months = F.greatest(F.count_distinct("month"), F.lit(1))
    spent = _sum("spent")
    return base.agg(
        F.sum("n").alias("n_transactions"),
        F.sum("n_credits").alias("n_credits"),
        F.sum("n_debits").alias("n_debits"),
        cents(_sum("income")).alias("income"),
        cents(spent).alias("spending"),
        cents(_sum("income") - spent).alias("net"),
        F.round(spent.cast("double") / months, 2).alias("avg_spend_per_month"),
        months.alias("n_months"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def spend_by_category(base: DataFrame) -> DataFrame:
    spent = base.groupBy("category").agg(_sum("spent").alias("spent")).where(F.col("spent") > 0)
    total = F.sum("spent").over(Window.partitionBy())
    return spent.select(
        "category",
        cents(F.col("spent")).alias("spent"),
        F.round(F.col("spent").cast("double") / total.cast("double") * 100, 1).alias("pct"),
    )


def monthly_cash_flow(base: DataFrame) -> DataFrame:
    return base.groupBy("month").agg(
        cents(_sum("income")).alias("income"),
        cents(_sum("spent")).alias("spending"),
        cents(_sum("income") - _sum("spent")).alias("net"),
    ).withColumn("month_label", F.date_format("month", "MMM yyyy"))


def category_trend(base: DataFrame) -> DataFrame:
    """Spending per month and category."""
    return base.where(F.col("spent") > 0).select("month", "category", cents(F.col("spent")).alias("spent"))


def ledger_domains(base: DataFrame) -> DataFrame:
    """The categories and the months that occur, for pick lists."""
    categories = base.select(F.lit("category").alias("kind"), F.col("category").alias("value"))
    months = base.select(F.lit("month").alias("kind"), F.date_format("month", "yyyy-MM").alias("value"))
    return categories.unionByName(months).distinct()


def top_merchants(ledger: DataFrame, n: int = 10) -> DataFrame:
    spent = ledger.where(F.col("amount") < 0).groupBy("description").agg(
        exact_sum(-F.col("amount")).alias("spent")
    )
    return spent.orderBy(F.desc("spent"), "description").limit(n)


def filtered_totals(view: DataFrame) -> DataFrame:
    """The strip above a filtered view: debits, credits, rows shown."""
    amount = F.col("amount")
    zero = F.lit(0.0)
    return view.agg(
        F.coalesce(exact_sum(F.when(amount < 0, -amount)), zero).alias("debits"),
        F.coalesce(exact_sum(F.when(amount > 0, amount)), zero).alias("credits"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def view_month_groups(view: DataFrame) -> DataFrame:
    """Month sections of a view with their rows and spending; show newest first."""
    amount = F.col("amount")
    return view.groupBy(F.trunc("date", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(exact_sum(F.when(amount < 0, -amount)), F.lit(0.0)).alias("spent"),
    ).withColumn("month_name", F.date_format("month", "MMMM yyyy"))


def ledger_head(ledger: DataFrame, n: int = 10, width: int = 44) -> DataFrame:
    """The first ``n`` transactions by date, descriptions cut for display."""
    return (
        ledger.orderBy("date", "description", "amount")
        .limit(n)
        .select("date", F.substring("description", 1, width).alias("description"),
                "amount", "transaction_type")
    )
