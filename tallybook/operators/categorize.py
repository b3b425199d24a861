"""Ordered keyword rules over transaction descriptions; the first match wins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook import vocab
from tallybook.functions.text import contains_any
from tallybook.functions.words import first_group, words_inside

Rules = Mapping[str, Sequence[str]]


def category_of(description: Column, rules: Rules | None = None) -> Column:
    """Category of a description, matched in one pass over the text."""
    return first_group(description, rules or vocab.RULES, vocab.UNCATEGORIZED)


def category_case(description: Column, rules: Rules | None = None) -> Column:
    """The same as built-in expressions only; fine for short rule lists."""
    text = F.lower(description)
    branches = [
        F.when(contains_any(text, [k.lower() for k in keywords]), category)
        for category, keywords in (rules or vocab.RULES).items()
    ]
    return F.coalesce(*branches, F.lit(vocab.UNCATEGORIZED))


def with_category(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    return df.withColumn("category", category_of(F.col("description"), rules))


def rules_table(spark: SparkSession, rules: Rules | None = None) -> DataFrame:
    """Rules as rows ``(priority, category, keyword)`` that users can edit and store."""
    rows = [
        (priority, category, keyword)
        for priority, (category, keywords) in enumerate((rules or vocab.RULES).items(), 1)
        for keyword in keywords
    ]
    return spark.createDataFrame(rows, "priority int, category string, keyword string")


def read_rules(rules: DataFrame) -> list[tuple[int, str, str]]:
    """The rule table as a list, in the order rules apply.

    Rules are settings that people edit, so they are read whole; nothing that grows
    with the ledger goes through here.
    """
    rows = rules.select("priority", "category", F.lower("keyword").alias("keyword")).toLocalIterator()
    return sorted((r["priority"], r["category"], r["keyword"]) for r in rows)


def with_category_from_table(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Like :func:`with_category` with rules from a table, in ``priority`` order.

    A category may own several priorities.
    """
    listed = read_rules(rules)
    found = words_inside(F.col("description"), [keyword for _, _, keyword in listed])
    names = F.array(*[F.lit(category) for _, category, _ in listed])
    first = F.try_element_at(names, F.try_element_at(found, F.lit(1)) + 1)
    return df.withColumn("category", F.coalesce(first, F.lit(vocab.UNCATEGORIZED)))


def category_distribution(categorized: DataFrame) -> DataFrame:
    return categorized.groupBy("category").agg(F.count(F.lit(1)).alias("txn_count"))


def uncategorized_review(categorized: DataFrame) -> DataFrame:
    """What the rules do not know yet: one row per description, not per transaction."""
    return (
        categorized.where(F.col("category") == vocab.UNCATEGORIZED)
        .groupBy("description")
        .agg(
            F.count(F.lit(1)).alias("txn_count"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
    )


def rule_audit(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Per keyword: rows that contain it, rows it decides, and who shadows it.

    ``shadowed_by`` names the first earlier rule whose keyword is part of this one;
    such a keyword can never decide a row.  Descriptions are counted first, so only
    distinct texts are matched, and only matching keywords become rows.
    """
    listed = read_rules(rules)
    texts = df.groupBy("description").agg(F.count(F.lit(1)).alias("n"))
    found = words_inside(F.col("description"), [keyword for _, _, keyword in listed])
    used = (
        texts.select("n", F.posexplode(found).alias("place", "rule"))
        .groupBy("rule")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("place") == 0, F.col("n")).otherwise(0)).alias("n_decided"),
        )
    )
    places = [(number, *rule) for number, rule in enumerate(listed)]
    audit = df.sparkSession.createDataFrame(places, "rule int, priority int, category string, keyword string")
    # Keywords are matched against all keywords like any text; places are in rule order.
    owners = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(c).alias("category")) for p, c, _ in listed])
    inside = F.transform(words_inside(F.col("keyword"), [keyword for _, _, keyword in listed]), lambda i: F.try_element_at(owners, i + 1))
    earlier = F.filter(inside, lambda rule: rule["priority"] < F.col("priority"))
    audit = audit.withColumn("shadowed_by", F.try_element_at(earlier, F.lit(1))["category"])
    return audit.join(used, "rule", "left").select(
        "priority", "category", "keyword", "shadowed_by",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_decided", F.lit(0)).alias("n_decided"),
    )


def spot_check(categorized: DataFrame, fragments: Sequence[str], rules: Rules | None = None) -> DataFrame:
    """First transaction (by date) for each fragment, else the fragment's own category."""
    spark = categorized.sparkSession
    names = F.array(*[F.lit(f) for f in fragments])
    found = words_inside(F.col("description"), fragments)
    first = (
        categorized.select(
            F.explode(found).alias("place"), "date", "description", "category",
        )
        .groupBy("place")
        .agg(F.min(F.struct("date", "description", "category")).alias("row"))
        .select(F.try_element_at(names, F.col("place") + 1).alias("fragment"), "row")
    )
    wanted = spark.createDataFrame([(f,) for f in fragments], "fragment string")
    return (
        wanted.join(first, "fragment", "left")
        .select(
            "fragment",
            F.col("row.date").alias("date"),
            F.coalesce("row.description", "fragment").alias("description"),
            F.coalesce("row.category", category_of(F.col("fragment"), rules)).alias("category"),
            F.col("row").isNotNull().alias("in_data"),
        )
    )
