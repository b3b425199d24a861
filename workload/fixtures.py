"""Ledgers, cells, responses, questions and cases made from the given tables.

The typed views are one SQL text for Spark and for the SQL check; the messy forms
(statement text, cells, JSON) exist in Spark only, so that the check compares what
the engine cleaned with values that never were text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook import vocab
from tallybook.operators.categorize import with_category
from tallybook.operators.clean import with_transaction_type
from tallybook.session import materialize

# m_id, description, sign, category
MERCHANTS = [
    (0, "Northwind Payroll - Head Office", 1, "Income"),
    (1, "Freelance Payment Studio Nine", 1, "Income"),
    (2, "Mutual Fund Sip Plan", -1, "Savings/Transfer"),
    (3, "Rent Payment Lakeview", -1, "Rent/Housing"),
    (4, "Bigbasket Weekly", -1, "Groceries"),
    (5, "D-Mart Old Town", -1, "Groceries"),
    (6, "Swiggy Dinner", -1, "Food & Dining"),
    (7, "Mcdonald'S Drive Thru", -1, "Food & Dining"),
    (8, "Uber Airport Ride", -1, "Transport"),
    (9, "Indian Oil Depot 7", -1, "Transport"),
    (10, "Bescom Meter 42", -1, "Utilities"),
    (11, "Jio Postpaid Bill", -1, "Utilities"),
    (12, "Netflix.Com", -1, "Subscriptions"),
    (13, "Amazon Prime Yearly", -1, "Subscriptions"),
    (14, "Apollo Pharmacy 1Mg", -1, "Healthcare"),
    (15, "Pvr Cinemas", -1, "Entertainment"),
    (16, "Amazon.In Order", -1, "Shopping"),
    (17, "Atm Withdrawal", -1, "Other"),
    (18, "Ngo Gift Drive", -1, "Other"),
    (19, "Pos Purchase #4821", -1, "Uncategorized"),
]
TRIGGERS = [word for words in vocab.CATEGORY_TRIGGERS.values() for word in words]
OPEN_WORDS = ["lately", "near the market", "maybe as a gift", "for the party"]

# case_id, question, label, merchant, category, month, offset of the stated total
CASES = [
    ("swiggy", "How much did I spend at Swiggy in total?", "Merchant", "swiggy", None, None, 0.0),
    ("feb_groceries", "What was my total grocery spend in February 2000?", "Category and month",
     None, "Groceries", "2000-02", 0.0),
    ("subscriptions", "How much did I spend on subscriptions across all months?", "Category",
     None, "Subscriptions", None, 0.0),
    ("income", "What was my total income across January, February, and March?", "Months without year",
     None, "Income", None, 0.0),
    ("jan_transport", "Show my transport spending in January 2001", "Category and month",
     None, "Transport", "2001-01", 1.5),
    ("shopping", "List everything for shopping", "Mixed signs", None, "Shopping", None, 0.0),
    ("two_months", "utility bills in Jan and Feb 2001", "Two months", None, "Utilities", "2001-01", 0.0),
    ("nothing", "groceries in march 2050", "No rows", None, "Groceries", "2050-03", 0.0),
    ("open", "what did I buy on a Sunday", "No filter", None, None, None, 0.0),
]


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _spark_text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _values(rows, quote) -> str:
    def cell(v):
        return str(v) if isinstance(v, (int, float)) else quote(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _pick(words, index: str, spark: bool) -> str:
    if spark:
        return f"element_at(array({', '.join(map(_spark_text, words))}), cast({index} AS int))"
    return f"list_extract([{', '.join(map(_text, words))}], {index})"


def typed_sql(lineitem: str = "lineitem", spark: bool = False) -> str:
    """The ledger with typed columns, its stated category, and columns to vary text by."""
    merchants = _values(MERCHANTS, _spark_text if spark else _text)
    return f"""
        SELECT cast(l.l_shipdate AS date) AS date, m.description, m.category,
               CASE WHEN l.l_quantity = 50 THEN cast(0 AS double)
                    WHEN m.m_id = 16 AND l.l_returnflag = 'R' THEN l.l_extendedprice
                    ELSE m.sign * l.l_extendedprice END AS amount,
               l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_returnflag,
               CASE WHEN l.l_tax > 0.075 THEN 'date' WHEN l.l_tax > 0.065 THEN 'amount'
                    WHEN l.l_tax > 0.055 THEN 'blank' ELSE '' END AS damage
        FROM {lineitem} l
        JOIN (VALUES {merchants}) AS m(m_id, description, sign, category)
          ON l.l_partkey % 20 = m.m_id"""


def questions_sql(events: str = "events", conversations: str = "conversations", spark: bool = False) -> str:
    """Questions built from every event, and every conversation turn as noise."""
    brand = _pick(vocab.BRANDS, f"event_id % {len(vocab.BRANDS)} + 1", spark)
    trigger = _pick(TRIGGERS, f"event_id % {len(TRIGGERS)} + 1", spark)
    month = _pick(vocab.MONTH_NAMES, "user_id % 12 + 1", spark)
    short = _pick(vocab.MONTH_TOKENS, f"user_id % {len(vocab.MONTH_TOKENS)} + 1", spark)
    year = _pick(["1999", "2000", "2001"], "event_id % 3 + 1", spark)
    word = _pick(OPEN_WORDS, "event_id % 4 + 1", spark)
    return f"""
        SELECT concat('e', cast(event_id AS varchar(20))) AS question_id,
               CASE event_type
                 WHEN 'click' THEN concat('How much did I spend at ',
                      CASE WHEN value > 50 THEN upper({brand}) ELSE {brand} END, ' in total?')
                 WHEN 'view' THEN concat('What was my total ', {trigger}, ' spend in ', {month}, ' ', {year}, '?')
                 WHEN 'purchase' THEN concat('Show my ', {trigger}, ' payments in ', upper({short}))
                 WHEN 'signup' THEN concat('How much on ', {trigger}, ' across all months?')
                 ELSE concat('what did I buy ', {word}) END AS question
        FROM {events}
        UNION ALL
        SELECT concat('c', cast(conv_id AS varchar(20)), '-', cast(turn AS varchar(20))), text
        FROM {conversations}"""


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table that is stored in fewer pieces than there are cores.

    A small file with one row group is one task, however many cores wait.  A table of
    many pieces, as any large one, is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _path(sf: str, name: str) -> str:
    return f"parquet.`{sf}/{name}.parquet`"


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.sql(typed_sql(_path(sf, "lineitem"), spark=True)))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The clean, categorized ledger (categories come from the rules)."""
    rows = typed(spark, sf).where("amount <> 0").select("date", "description", "amount")
    return with_category(with_transaction_type(rows))


def raw_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger as a bank would export it, with some unreadable rows."""
    size = F.format_string("%,.2f", F.abs("amount"))
    negative = F.col("amount") < 0
    amount = (
        F.when((F.col("l_suppkey") % 3 == 0) & negative, F.concat(F.lit("("), size, F.lit(")")))
        .when(negative, F.concat(F.lit("-₹"), size))
        .otherwise(F.concat(F.lit("₹ "), size))
    )
    date = (
        F.when(F.col("l_linenumber") % 3 == 0, F.date_format("date", "yyyy-MM-dd"))
        .when(F.col("l_linenumber") % 3 == 1, F.date_format("date", "dd MMM yyyy"))
        .otherwise(F.date_format("date", "MM/dd/yyyy"))
    )
    text = (
        F.when(F.col("l_suppkey") % 3 == 0, F.upper("description"))
        .when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("  "), F.lower("description"), F.lit(" ")))
        .otherwise(F.replace("description", F.lit(" "), F.lit("   ")))
    )
    damage = F.col("damage")
    return typed(spark, sf).select(
        F.when(damage == "date", "not-a-date").otherwise(date).alias("Value Date"),
        F.when(damage == "blank", "   ").otherwise(text).alias("Narrative"),
        F.when(damage == "amount", "n/a").otherwise(amount).alias(" transaction AMOUNT "),
    )


def raw_split(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger with debit and credit in two text columns."""
    size = F.format_string("%,.2f", F.abs("amount"))
    return typed(spark, sf).select(
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("Posted Date"),
        F.col("description").alias("Memo"),
        F.when(F.col("amount") < 0, size).alias("Debit"),
        F.when(F.col("amount") > 0, size).alias("Credit"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """One document per order, as a stored table; its number modulo 5 tells its kind.

    0, 1: date, description, amount with a header that repeats; 2: debit and credit
    columns; 3: no header, an extra reference column; 4: nothing usable.
    """
    kind = F.col("l_orderkey") % 5
    day = F.date_format("date", "yyyy-MM-dd")
    number = F.format_string("%.2f", "amount")
    size = F.format_string("%.2f", F.abs("amount"))
    body = (
        F.when(kind == 2, F.array(day, "description", F.when(F.col("amount") < 0, size),
                                  F.when(F.col("amount") >= 0, size)))
        .when(kind == 3, F.array(day, F.concat(F.lit("R"), F.col("l_suppkey").cast("string")), number, "description"))
        .when(kind == 4, F.array(F.lit("foo"), "description"))
        .otherwise(F.array("description", F.concat(day, F.lit(" ")), number))
    )
    rows = typed(spark, sf).select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber") % 2).cast("int").alias("table_no"),
        F.col("l_suppkey").alias("place"),
        body.alias("cells"),
    )
    tables = rows.select("doc_id", "table_no").distinct()
    kind = F.col("doc_id") % 5
    header = F.when(kind == 2, F.array(*map(F.lit, ["Transaction Date", "Narrative", "Debit", "Credit"]))).otherwise(
        F.array(*map(F.lit, ["DETAILS", " Date", "Amount"]))
    )
    extra = tables.where(kind < 3).select(
        "doc_id", "table_no",
        F.explode(F.array(
            F.struct(F.lit(-1).cast("bigint").alias("place"), header.alias("cells")),
            F.struct(F.lit(10).cast("bigint").alias("place"), header.alias("cells")),
            F.struct(F.lit(20).cast("bigint").alias("place"), F.transform(header, lambda c: F.lit(None).cast("string")).alias("cells")),
        )).alias("row"),
    ).select("doc_id", "table_no", "row.*")
    order = Window.partitionBy("doc_id", "table_no").orderBy("place", "cells")
    return materialize(rows.unionByName(extra).select(
        "doc_id", "table_no", (F.row_number().over(order) - 1).cast("bigint").alias("row_no"), "cells"
    ))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """One model response per event: bare array, fenced array, or an object in prose.

    A signup response repeats its record; an error response has no amount.
    """
    e = spread(table(spark, sf, "events"))
    day = F.date_format("ts", "yyyy-MM-dd")
    kind = F.col("event_type")
    amount = F.when(kind == "error", F.lit("abc")).when(
        kind == "view", F.format_string("-%,.2f", "value")
    ).otherwise(F.format_string("%.2f", "value"))
    record = F.format_string(
        '{"amount": "%s", "upi_id": "%s", "payee_name": "%s", "utr": "%s", "date": "%s", "type": "%s"}',
        amount,
        F.when(kind == "click", F.concat(F.lit("shop"), F.col("user_id").cast("string"), F.lit("@bank"))).otherwise("@none"),
        F.when(kind == "purchase", " Corner Shop ").otherwise(""),
        F.when(kind == "view", "").otherwise(F.concat(F.lit("k"), F.get_json_object("props", "$.k"))),
        F.when(kind == "view", "").otherwise(day),
        F.when(kind == "click", "Credit").otherwise("debit"),
    )
    bare = F.when(kind == "signup", F.concat(F.lit("["), record, F.lit(", 5, "), record, F.lit("]"))).otherwise(
        F.concat(F.lit("["), record, F.lit("]"))
    )
    shape = F.col("event_id") % 3
    text = (
        F.when(shape == 0, bare)
        .when(shape == 1, F.concat(F.lit("```json\n"), bare, F.lit("\n```")))
        .when(kind == "signup", F.concat(F.lit("Sure! "), bare, F.lit(" hope that helps")))
        .otherwise(F.concat(F.lit("Here it is: "), record, F.lit(" - bye")))
    )
    return e.select(F.col("event_id").alias("image_id"), text.alias("raw_text"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.sql(questions_sql(_path(sf, "events"), _path(sf, "conversations"), spark=True)))


def case_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [c[:6] for c in CASES],
        "case_id string, question string, label string, merchant string, category string, month string",
    )


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Golden cases; the stated totals come from the typed ledger (one is wrong)."""
    rows = typed(spark, sf).where("amount <> 0").withColumn("month", F.date_format("date", "yyyy-MM"))
    conditions = []
    for case_id, _, _, merchant, category, month, offset in CASES:
        test = F.lit(True)
        if merchant:
            test = test & F.contains(F.lower("description"), F.lit(merchant))
        if category:
            test = test & (F.col("category") == category)
        if month:
            test = test & (F.col("month") == month)
        total = F.sum(F.when(test, F.abs("amount")).cast("decimal(24,6)"))
        value = F.round(F.coalesce(total, F.lit(0)).cast("double") + offset, 2)
        conditions.append(F.struct(F.lit(case_id).alias("case_id"), value.alias("expected_total")))
    totals = rows.agg(F.array(*conditions).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return case_list(spark).join(totals, "case_id")


def golden_questions(spark: SparkSession) -> DataFrame:
    return case_list(spark).select(F.col("case_id").alias("question_id"), "question")


def answers_text(spark: SparkSession, sf: str) -> DataFrame:
    """A model answer per order: stated on the answer line, in prose, or not at all."""
    o = spread(table(spark, sf, "orders"))
    total = F.col("o_totalprice")
    said = F.format_string("₹%,.2f", F.when(F.col("o_orderpriority") == "1-URGENT", total - 5).otherwise(total))
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(
            F.lit("Hello\n  **ANSWER:** you spent "), said, F.lit(" in total, over ₹ 1.\n- x ₹99,999,999.00")))
        .when(F.col("o_orderstatus") == "O", F.concat(
            F.lit("**Answer:** see below\nfirst ₹0.01 then "), said, F.lit(" and ₹0.5 more")))
        .otherwise("I cannot determine this from the available transactions.")
    )
    return o.select(F.col("o_orderkey").alias("question_id"), text.alias("raw_text"), total.alias("expected_total"))
