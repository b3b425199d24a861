import random
import time

import pytest
from pyspark.sql import functions as F

from tallybook import vocab
from tallybook.plans.questions import (
    NO_FILTER_SCOPE,
    categories_of,
    intent_of,
    merchant_of,
    month_numbers_of,
    plan_questions,
    vocabulary_check,
)
from workload import queries

CASES = {
    "Sum of my kirana runs, November 2031": dict(categories=["Groceries"], months=["2031-11"], month_nums=[], intent="aggregate"),
    "lease for August please": dict(categories=["Rent/Housing"], months=[], month_nums=[8], intent="lookup"),
    "Payroll of April, June and October": dict(month_nums=[4, 6, 10], categories=["Income"]),
    "outgoings, Dec": dict(month_nums=[12], intent="lookup"),
    "combined ott cost, every month of June": dict(months=[], month_nums=[], categories=["Subscriptions"]),
    "julia paid at the marble counter": dict(month_nums=[], has_filter=False),
    "diesel or taxi, which one": dict(categories=["Transport"]),
    "was zepto cheaper than the supermarket": dict(merchant="zepto", categories=[]),
    "is my pizza hut order or pizza in there": dict(merchant="pizza hut", categories=[]),
    "where did it go": dict(has_filter=False, wants_all=False, scope=NO_FILTER_SCOPE),
    "a tally of everything, altogether": dict(intent="aggregate", wants_all=True, has_filter=False),
    "show the dentist, or any clinic": dict(wants_all=True, has_filter=True, categories=["Healthcare"]),
    "housing plus vegetables, sept 2024 or 2025": dict(categories=["Rent/Housing", "Groceries"], months=["2024-09"]),
    "kirana, Nov 2031": dict(scope="category = Groceries; month = 2031-11"),
    "croma in jan and oct": dict(scope="merchant contains 'croma'; month = January, October"),
    "éola und olaé": dict(merchant=None, categories=[]),
}


@pytest.fixture(scope="module")
def planned(spark):
    df = spark.createDataFrame([(q, q) for q in CASES], "question_id string, question string")
    return {r["question_id"]: r.asDict() for r in plan_questions(df).collect()}


@pytest.mark.parametrize("question", CASES)
def test_plan(planned, question):
    got = planned[question]
    assert {k: got[k] for k in CASES[question]} == CASES[question]


def test_a_null_question_is_a_lookup(spark):
    row = plan_questions(spark.createDataFrame([("n", None)], "question_id string, question string")).first()
    assert (row["intent"], row["has_filter"], row["wants_all"]) == ("lookup", False, False)


def test_every_trigger_category_is_known(spark):
    assert vocabulary_check(spark).count() == 0
    assert vocabulary_check(spark, {"Travel": ["trip"]}).count() == 1


def _patterns(df, **words):
    """What the compiled patterns say of each question."""
    q = F.col("question")
    merchant = merchant_of(q, words.get("brands"))
    found = df.select("question_id", merchant.alias("merchant"), categories_of(q, words.get("triggers")).alias("c"), month_numbers_of(q).alias("n"), intent_of(q).alias("intent"))
    none = F.array().cast("array<string>")
    return found.select("question_id", "merchant", F.when(F.col("merchant").isNotNull(), none).otherwise(F.col("c")).alias("c"), "n", "intent")


def test_words_in_one_pass_equal_the_patterns(spark):
    rng = random.Random(5)
    words = [*vocab.BRANDS, *vocab.MONTH_TOKENS, *[w for ws in vocab.CATEGORY_TRIGGERS.values() for w in ws], "all months", "total", "x", "20", "İ"]
    borders = ["", " ", "-", "_", "é", "\u0301", "\u200d", "٣", "Ⓐ", "\u00a0", "\n", "7", ".", "K", "‿"]
    texts = ["".join(rng.choice(borders) + (w.upper() if rng.random() < 0.2 else w) + rng.choice(borders) for w in rng.choices(words, k=rng.randint(0, 4))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "question_id int, question string")
    df = df.withColumn("question", F.replace("question", F.lit("20"), F.lit("2")))  # numbers show as months without a year
    for given in ({}, {"brands": ["ola", "OLA", "-x", "x-", "", "ola cab"], "triggers": {"Transport": ["ola", "é"], "Trips": ["x"], "Income": []}}):
        got = plan_questions(df, **given).select("question_id", "merchant", "categories", "month_nums", "intent")
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, _patterns(df, **given).collect()), key=lambda r: r[0])


def test_long_texts_are_planned_at_a_fraction_of_the_patterns_cost(spark):
    text = " ".join(f"thnd{i} oution, er{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{text} {i}") for i in range(6000)], "question_id int, question string").coalesce(1).cache()
    df.count()

    def seconds(made):
        taken = []
        for _ in range(2):
            start = time.perf_counter()
            made.write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        return min(taken)

    assert seconds(plan_questions(df)) < 0.5 * seconds(_patterns(df))


def test_totals_plan_each_question_once(spark, tmp_path):
    spark.createDataFrame([(1, 7, "x", "how much in may", 1.0)], "event_id bigint, user_id bigint, event_type string, props string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, 1, "user", "what did I buy")], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, 1, 1, 1, 3.0, 10.0, 0.0, "N", "2000-01-05")], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = queries.QUERIES["answer_totals"](spark, str(tmp_path))
    assert "conv_id" not in made._jdf.queryExecution().toString()  # read when the plans were written, not again
    assert made.count() == 2
