import datetime
import random

import pytest
from decimal import Context, Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from tallybook.functions.text import title_case
from tallybook.functions.values import exact_sum, parse_amount, parse_date
from tallybook.operators import clean


def frame(spark, columns, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"`{c}` string" for c in columns))


def test_schema_signs_and_types(spark):
    raw = frame(spark, ["date", "description", "amount"],
                ("2031-11-05", "LAMP  SHOP", "-41.20"), ("2031-11-03", "PRIZE MONEY", "410.00"))
    ledger = clean.clean_ledger(raw)
    assert ledger.columns == ["date", "description", "amount", "transaction_type"]
    rows = {r["description"]: r for r in ledger.collect()}
    assert rows["Prize Money"]["amount"] == 410.0
    assert rows["Prize Money"]["transaction_type"] == "credit"
    assert rows["Lamp Shop"]["transaction_type"] == "debit"


@pytest.mark.parametrize("text,value", [
    ("(50.00)", -50.0), ("$1,234.56", 1234.56), ("-$20.00", -20.0), ("₹ 12", 12.0),
    ("1.234,56", 1.23456), ("(-50)", None), ("12-3", None), ("n/a", None), ("", None), (None, None),
])
def test_amounts(spark, text, value):
    row = frame(spark, ["a"], (text,)).select(parse_amount(F.col("a")).alias("v")).first()
    assert row["v"] == value


def test_dates_of_every_form(spark):
    rng = random.Random(5)
    forms = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m-%d-%y", "%d %b %Y", "%d-%b-%y", "%B %d, %Y",
             "%b %d %Y", "%d %B %Y", "%Y-%m-%d 13:45:00", "%m/%d/%Y 1:05 PM", "%Y-%m-%dT13:45:00Z",
             "%Y-%m-%dT13:45:00.120+05:30", "%Y%m%d", "%a, %d %b %Y", "%A %B %d, %Y", "%Y %b %d", "\t%Y-%m-%d\n"]
    rows = []
    for _ in range(400):
        day = datetime.date(1990, 1, 1) + datetime.timedelta(rng.randrange(25_000))
        rows.append((day.strftime(rng.choice(forms)), day))
    got = spark.createDataFrame(rows, "s string, d date").withColumn("p", parse_date(F.col("s")))
    assert got.where("NOT (p <=> d)").collect() == []


def test_dates_day_first_fallback_and_rejects(spark):
    cases = {"31/01/2026": datetime.date(2026, 1, 31), "not-a-date": None, "2026-02-30": None,
             "May 2026": None, "13:45": None, "2026": None, "2026-13-01": None, "marble 5 2026": None}
    df = frame(spark, ["s"], *[(s,) for s in cases]).select("s", parse_date(F.col("s")).alias("d"))
    assert {r["s"]: r["d"] for r in df.collect()} == cases


def test_title_case_matches_python(spark):
    rng = random.Random(1)
    alphabet = "aBé ß'.-_#1Zü9/&"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 20))) for _ in range(500)]
    df = frame(spark, ["s"], *[(t,) for t in texts]).select("s", title_case(F.col("s")).alias("t"))
    assert [(r["s"], r["t"]) for r in df.collect() if r["s"].title() != r["t"]] == []


def test_split_columns_merge(spark):
    raw = frame(spark, ["date", "description", "Debit", "Credit"],
                ("2026-01-10", "RENT PAYMENT", "18000", None), ("2026-01-03", "SALARY", "", "62,000"))
    rows = {r["description"]: r["amount"] for r in clean.clean_ledger(raw).collect()}
    assert rows == {"Rent Payment": -18000.0, "Salary": 62000.0}


def test_single_amount_beats_split_sides(spark):
    raw = frame(spark, ["date", "details", "debit", "credit", "value"], ("2026-01-10", "X", "5", "7", "-9"))
    assert clean.clean_ledger(raw).first()["amount"] == -9.0


def test_aliases_first_in_list_wins(spark):
    raw = frame(spark, [" Value Date", "Transaction Date ", "MERCHANT", "Transaction Amount"],
                ("2026-05-05", "2026-03-01", "SWIGGY", "-420.00"))
    row = clean.clean_ledger(raw).first()
    assert (str(row["date"]), row["description"], row["amount"]) == ("2026-03-01", "Swiggy", -420.0)


def test_lone_debit_keeps_or_turns_its_sign(spark):
    raw = frame(spark, ["date", "memo", "debit"], ("2026-01-01", "x", "5"))
    assert clean.clean_ledger(raw).first()["amount"] == 5.0
    assert clean.normalize_columns(raw, debit_only_negative=True).first()["amount"] == -5.0


def test_missing_columns_raise(spark):
    with pytest.raises(clean.MissingColumns):
        clean.clean_ledger(frame(spark, ["when", "what", "howmuch"], ("2026-01-02", "COFFEE", "-20")))


def test_rejects_are_counted_by_reason(spark):
    raw = frame(spark, ["date", "description", "amount"],
                ("2026-01-01", "Opening Balance", "0.00"), ("nope", "Ghost", "-10"),
                ("2026-01-02", " ", "-1"), ("2026-01-02", None, "-1"), ("2026-01-02", "x", "abc"),
                ("2026-01-02", "fine", "-20"))
    got = {r["reason"]: r["n_rows"] for r in clean.clean_rejects(raw).collect()}
    assert got == {"zero amount": 1, "unreadable date": 1, "blank description": 2, "unreadable amount": 1}
    assert clean.clean_ledger(raw).count() == 1


def test_drops_are_counted_while_the_ledger_is_written(spark, tmp_path):
    raw = frame(spark, ["date", "description", "amount", "page"],
                ("2026-01-01", "Opening Balance", "0.00", "1"), ("nope", "Ghost", "-10", "1"),
                ("2026-01-02", " ", "-1", "2"), ("2026-01-02", None, "-1", "2"), ("2026-01-02", "x", "abc", "2"),
                ("2026-01-02", "fine", "-20", "3"), ("2026-01-02", "fine", "-20", "3"), (None, None, None, None))
    ledger, seen = clean.clean_ledger_observed(raw, keep=["page"])
    plan = ledger._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate inline") == 1
    ledger.write.parquet(str(tmp_path / "ledger"))
    assert seen.get == {"unreadable date": 2, "unreadable amount": 1, "zero amount": 1, "blank description": 2, "kept": 2, "rows": 8}
    written = spark.read.parquet(str(tmp_path / "ledger"))
    assert sorted(written.collect()) == sorted(clean.clean_ledger(raw, keep=["page"]).collect())
    ledger.count()  # a later action does not count again
    assert seen.get["rows"] == 8
    nothing, none_seen = clean.clean_ledger_observed(raw.where("false"))
    nothing.write.parquet(str(tmp_path / "nothing"))
    assert set(none_seen.get.values()) == {0}


def test_numeric_amounts_are_not_read_as_text(spark):
    raw = spark.createDataFrame([("2026-01-01", "x", 1.5e7)], "date string, payee string, amount double")
    assert clean.clean_ledger(raw).first()["amount"] == 1.5e7


def test_exact_sum_ignores_order_and_sign(spark):
    values = [0.1, 0.2, -0.3, 1e9, -1e9, 12345.67, -0.01]
    df = spark.createDataFrame([(v,) for v in values * 50], "a double")
    assert df.agg(exact_sum(F.col("a")).alias("s")).first()["s"] == round(12345.66 * 50, 2)
    assert df.where("false").agg(exact_sum(F.col("a")).alias("s")).first()["s"] is None


def test_parsing_runs_once_per_row(spark):
    raw = frame(spark, ["date", "description", "amount"], ("2026-01-01", "x", "1"))
    plan = clean.clean_ledger(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("not a date") == 0 and plan.count("Generate inline") == 1
    assert "Exchange" not in plan


def test_large_amounts_are_added_exactly(spark):
    raw = frame(spark, ["date", "description", "amount"],
                ("2031-11-05", "A", "UPI 123456789012345"), ("2031-11-05", "B", "0.10"), ("2031-11-05", "C", "-7e"),
                ("2031-11-05", "D", "9" * 30), ("2031-11-05", "E", "(20000000000000.25)"), ("2031-11-05", "\t", "1"))
    ledger = clean.clean_ledger(raw)
    assert ledger.count() == 4
    assert ledger.agg(exact_sum(F.col("amount")).alias("s")).first()["s"] == 103456789012337.85
    from tallybook.operators.identity import with_txn_id

    assert with_txn_id(ledger).select("txn_id").distinct().count() == 4
    rejects = {r["reason"]: r["n_rows"] for r in clean.clean_rejects(raw).collect()}
    assert rejects == {"unreadable amount": 1, "blank description": 1}


def test_sums_of_the_largest_amounts(spark):
    from tallybook.functions.values import exact_total

    amounts = [9e23, -9e23, 0.01, 1e15 + 0.25, 923456789012345678901234.0, -0.000001, 5e-7, float("nan"), float("inf"), 1e24, None]
    kept = [a for a in amounts if a is not None and abs(a) < 1e24]
    for copies in (1, 20, 1_000_000):
        df = spark.range(copies).select(F.explode(F.array(*[F.lit(a).cast("double") for a in amounts])).alias("a"))
        want = sum(round(Fraction(a * 1_000_000.0)) for a in kept) * copies
        assert df.agg(exact_total(F.col("a")).alias("t")).first()["t"] == Decimal(want).scaleb(-6, Context(prec=60))
    one = spark.range(1_000_000).select(F.lit(9e23).alias("a")).agg(exact_total(F.col("a")).alias("t")).first()["t"]
    assert one == Decimal(int(9e23 * 1e6) * 1_000_000).scaleb(-6, Context(prec=60))


def test_parsing_runs_in_methods_that_the_jvm_compiles(spark):
    own = spark.newSession()
    raw = own.createDataFrame([("2026-01-31", "Shop", "-1.50")], "date string, description string, amount string")
    assert clean.clean_ledger(raw).count() == 1
    assert int(own.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
    stated = spark.newSession()
    stated.conf.set("spark.sql.codegen.hugeMethodLimit", 9000)
    raw = stated.createDataFrame([("2026-01-31", "Shop", "-1.50")], "date string, description string, amount string")
    assert clean.clean_ledger(raw).count() == 1
    assert int(stated.conf.get("spark.sql.codegen.hugeMethodLimit")) == 9000
