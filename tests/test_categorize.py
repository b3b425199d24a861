import pytest
from pyspark.sql import functions as F

from tallybook import vocab
from tallybook.operators import categorize

# One description per category, written around the merchants of the test ledger.
EXPECTED = [
    ("Northwind payroll, head office", "Income"), ("autumn SIP TRANSFER no 3", "Savings/Transfer"),
    ("housing society dues block C", "Rent/Housing"), ("old town d-mart visit", "Groceries"),
    ("swiggy late dinner", "Food & Dining"), ("depot 7 indian oil refill", "Transport"),
    ("bescom meter 42 arrears", "Utilities"), ("netflix.com yearly plan", "Subscriptions"),
    ("corner dentist visit", "Healthcare"), ("pvr row K seats", "Entertainment"),
    ("croma headphones", "Shopping"), ("ngo gift drive", "Other"), ("pos purchase #4821", "Uncategorized"),
    ("payroll of the bazaar", "Income"), ("dhaba in the bazaar", "Groceries"),
    ("gola", "Uncategorized"), ("gola juice", "Transport"), ("", "Uncategorized"), (None, "Uncategorized"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(d, c) for d, c in EXPECTED], "description string, expected string")


def test_first_matching_category_wins(texts):
    rows = categorize.with_category(texts).where("NOT (category <=> expected)").collect()
    assert rows == []
    assert "category" not in texts.columns


def test_built_in_expression_and_rule_table_agree(spark, texts):
    keywords = [k for words in vocab.RULES.values() for k in words]
    more = spark.createDataFrame([(f"x {k} y {keywords[-1 - i]}", "") for i, k in enumerate(keywords)],
                                 "description string, expected string")
    df = texts.unionByName(more)
    both = categorize.with_category_from_table(
        categorize.with_category(df).withColumnRenamed("category", "udf"), categorize.rules_table(spark)
    ).withColumn("built_in", categorize.category_case(F.coalesce("description", F.lit(""))))
    assert both.where("udf <> category OR udf <> built_in").count() == 0


def test_user_rules_follow_priority(spark):
    rules = spark.createDataFrame([(2, "B", "Shop"), (1, "A", "coffee")], "priority int, category string, keyword string")
    df = spark.createDataFrame([("Coffee SHOP",), ("toy shop",), ("none",)], "description string")
    rows = categorize.with_category_from_table(df, rules).collect()
    assert [r["category"] for r in rows] == ["A", "B", "Uncategorized"]


def test_audit_names_shadowed_keywords(spark):
    df = spark.createDataFrame([("Bluesmart ride",), ("bounce cab",)] * 3, "description string")
    rows = categorize.rule_audit(df, categorize.rules_table(spark)).collect()
    shadowed = {r["keyword"]: r["shadowed_by"] for r in rows if r["shadowed_by"]}
    assert shadowed == {"bluesmart": "Groceries", "district by zomato": "Food & Dining", "cheque bounce": "Transport"}
    assert len(rows) == 250
    by_keyword = {r["keyword"]: (r["n_rows"], r["n_decided"]) for r in rows}
    assert by_keyword["bluesmart"] == (3, 0) and by_keyword["mart"] == (3, 3)
    assert by_keyword["bounce"] == (3, 3) and by_keyword["netflix"] == (0, 0)


def test_review_and_spot_check(statement):
    review = categorize.uncategorized_review(statement).collect()
    assert [(r["description"], r["txn_count"]) for r in review] == [("Payment Ref 77", 3)]
    rows = {r["fragment"]: r for r in categorize.spot_check(statement, ["swiggy", "Zomato"]).collect()}
    assert rows["swiggy"]["description"] == "Swiggy Dinner" and rows["swiggy"]["in_data"]
    assert rows["Zomato"]["category"] == "Food & Dining" and not rows["Zomato"]["in_data"]
