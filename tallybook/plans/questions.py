"""Questions to retrieval plans, for a whole table of questions at once.

Everything is a projection over the question text: no join with the vocabularies, no shuffle.
One pass finds all words of the vocabularies; the compiled patterns, which say the same but
cost many times as much, judge the texts in which a word touches a character beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook import vocab
from tallybook.operators.clean import computed
from tallybook.functions.text import (
    contains_any,
    contains_word,
    longest_word,
    regex_quote,
)
from tallybook.functions.words import word_finder

NO_FILTER_SCOPE = "no metadata filter (ranked by semantic relevance)"
_MONTH_KEYS = [name[:3].lower() for name in vocab.MONTH_NAMES]


def merchant_of(question: Column, brands: Sequence[str] | None = None) -> Column:
    """The longest known brand named in the question, else null."""
    return longest_word(F.lower(question), list(brands or vocab.BRANDS))


def categories_of(question: Column, triggers: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Categories named by the question, in the order of the trigger table."""
    text = F.lower(question)
    named = [
        F.when(contains_word(text, words), category)
        for category, words in (triggers or vocab.CATEGORY_TRIGGERS).items()
        if category in vocab.CATEGORIES
    ]
    return F.array_compact(F.array(*named))


def month_numbers_of(question: Column) -> Column:
    """Sorted month numbers named by the question, empty for "all months"."""
    text = F.lower(question)
    tokens = sorted(vocab.MONTH_TOKENS, key=len, reverse=True)
    pattern = r"(?U)\b(" + "|".join(regex_quote(t) for t in tokens) + r")\b"
    keys = F.array(*[F.lit(k) for k in _MONTH_KEYS])
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
        lambda token: F.array_position(keys, F.substring(token, 1, 3)).cast("int"),
    )
    none = F.array().cast("array<int>")
    return F.when(contains_any(text, vocab.ALL_MONTHS_PHRASES), none).otherwise(
        F.array_sort(F.array_distinct(numbers))
    )


def year_of(question: Column) -> Column:
    """The first year 2000 to 2099 in the question, else an empty string."""
    year = F.regexp_extract(question, r"(?U)\b(20[0-9]{2})\b", 1)
    return F.when(~F.contains(question, F.lit("20")), "").otherwise(year)


def intent_of(question: Column, words: Sequence[str] | None = None) -> Column:
    asks_total = contains_any(F.lower(question), words or vocab.AGGREGATE_WORDS)
    return F.when(asks_total, "aggregate").otherwise("lookup")


def scope_of(merchant: Column, categories: Column, months: Column, month_nums: Column) -> Column:
    """What a plan filters on, in words."""
    names = F.array(*[F.lit(m) for m in vocab.MONTH_NAMES])
    month_text = F.when(F.size(months) > 0, F.array_join(months, ", ")).when(
        F.size(month_nums) > 0,
        F.array_join(F.transform(month_nums, lambda n: F.try_element_at(names, n)), ", "),
    )
    parts = F.array_compact(F.array(
        F.concat(F.lit("merchant contains '"), merchant, F.lit("'")),
        F.when(F.size(categories) > 0, F.concat(F.lit("category = "), F.array_join(categories, ", "))),
        F.concat(F.lit("month = "), month_text),
    ))
    return F.when(F.size(parts) == 0, NO_FILTER_SCOPE).otherwise(F.array_join(parts, "; "))


_READ = pa.struct([
    ("sure", pa.bool_()), ("merchant", pa.string()), ("numbers", pa.list_(pa.int32())), ("categories", pa.list_(pa.string())),
    ("asks_total", pa.bool_()), ("all_months", pa.bool_())])


def _read(text: Column, brands: Sequence[str], triggers: Mapping[str, Sequence[str]]) -> Column:
    """What the words of a lower-cased question say; where ``sure`` is false, only the last two fields count."""
    ordered = sorted(brands, key=len, reverse=True)
    names = [c for c in triggers if c in vocab.CATEGORIES]
    tokens = list(vocab.MONTH_TOKENS)
    numbers = [_MONTH_KEYS.index(t[:3]) + 1 for t in tokens]
    whole, inside = [ordered, tokens, *[list(triggers[c]) for c in names]], [list(vocab.AGGREGATE_WORDS), list(vocab.ALL_MONTHS_PHRASES)]

    @F.arrow_udf("sure boolean, merchant string, numbers array<int>, categories array<string>, asks_total boolean, all_months boolean")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = word_finder(whole, inside)
        for texts in batches:
            rows = []
            for question in texts.to_pylist():
                if question is None:
                    rows.append((True, None, None, [], False, False))
                    continue
                (brand, month, *named), (asks_total, all_months), sure = find(question)
                rows.append((
                    sure, ordered[min(brand)] if brand else None, [] if all_months else sorted({numbers[i] for i in month}),
                    [c for c, found in zip(names, named) if found], asks_total, all_months))
            columns = list(zip(*rows)) or [()] * len(_READ)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ)], fields=list(_READ))

    return read(text)


def plan_questions(
    questions: DataFrame,
    brands: Sequence[str] | None = None,
    triggers: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Plans: the questions plus ``intent, merchant, categories, months, month_nums,
    has_filter, wants_all, scope``.

    A merchant is more precise than a category and replaces it.  Months carry the
    year when the question names one.  ``wants_all`` asks for the complete matching
    set: every filter and every total needs it.
    """
    text = F.col("question")
    no_names = F.array().cast("array<string>")
    no_numbers = F.array().cast("array<int>")
    named, used = list(brands or vocab.BRANDS), triggers or vocab.CATEGORY_TRIGGERS
    sure = F.col("_read.sure")
    read = questions.withColumn("_read", _read(F.lower(text), named, used))
    merchant = computed(read, merchant=F.when(sure, F.col("_read.merchant")).otherwise(merchant_of(text, named)))
    found = computed(
        merchant,
        intent=F.when(F.col("_read.asks_total"), "aggregate").otherwise("lookup"),
        _numbers=F.when(sure, F.col("_read.numbers")).otherwise(month_numbers_of(text)),
        _year=year_of(text),
        categories=F.when(F.col("merchant").isNotNull(), no_names).when(sure, F.coalesce("_read.categories", no_names)).otherwise(categories_of(text, used)),
    )
    dated = found.withColumns({
        "months": F.when(
            F.col("_year") != "",
            F.transform(
                "_numbers",
                lambda n: F.concat(F.col("_year"), F.lit("-"), F.lpad(n.cast("string"), 2, "0")),
            ),
        ).otherwise(no_names),
        "month_nums": F.when(F.col("_year") != "", no_numbers).otherwise(F.col("_numbers")),
    })
    # A null question has no filter and asks for no total.
    has_filter = F.coalesce(
        F.col("merchant").isNotNull() | (F.size("categories") > 0) | (F.size("_numbers") > 0), F.lit(False)
    )
    return dated.withColumn("has_filter", has_filter).select(
        *questions.columns, "intent", "merchant", "categories", "months", "month_nums", "has_filter",
        (F.col("has_filter") | (F.col("intent") == "aggregate")).alias("wants_all"),
        scope_of(*(F.col(c) for c in ("merchant", "categories", "months", "month_nums"))).alias("scope"),
    )


def vocabulary_check(
    spark: SparkSession, triggers: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Trigger categories that are no ledger category (they are ignored in plans)."""
    used = spark.createDataFrame(
        [(c, w) for c, words in (triggers or vocab.CATEGORY_TRIGGERS).items() for w in words],
        "category string, trigger string",
    )
    known = spark.createDataFrame([(c,) for c in vocab.CATEGORIES], "category string")
    return used.join(known, "category", "left_anti")
