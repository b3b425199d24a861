"""Mixing sources to target weights with exact budgets of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import WORD, columns_of, free_name

#: Leading hex digits of a document's key that name its slice of the key range.
SLICE_DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_key(source: Column) -> Column:
    """Source names as text that sorts by code point with null last and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Weights for a table of distinct ``source_key`` rows: the cycle over the sorted keys.

    One row a source; the list of sources is configuration, not data.
    """
    place = (F.row_number().over(Window.orderBy("source_key")) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in cycle]), (place + 1).cast("int"))
    return sources.select("source_key", weight.alias("weight"))


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets of sources (source_key, source_size, weight), each at most ``most`` epochs.

    ``share`` of all words is split by weight; what exceeds ``most`` times a source's size
    goes to the other sources by weight until none is above.  That is one water level:
    sources in the order of capacity by weight are full up to the first whose share of the
    rest fits.  A source of weight 0 or without words gets 0.
    """
    cap = F.col("source_size") * most
    order = Window.orderBy((cap / F.col("weight")).asc_nulls_last(), "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0).cast("bigint")
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum(cap).over(before), zero)) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero))
    rows = sizes.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= cap, F.struct("place", "level"))
    rows = rows.withColumn("level", F.min(fits).over(every)["level"])
    target = F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double")))
    return rows.select("source_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """How many words a mix takes of each document (doc_id, source, size).

    Each document gets a hash-random key.  Within a source documents are sorted by key in
    slices of the key range; sums of slices give each slice its start, a running sum inside
    the slice gives each document its place, so no source passes through one task.  A source
    whose target is k whole epochs and a rest takes every document k times and the rest from
    the first documents; the document on the border gives only its first words, so the
    taken words of a source are exactly the whole part of its target.

    ``weights`` has (source_key, weight); by default the cycle 3, 1, 2 over the sorted
    names.  Returns ``doc_id, source, size, source_size, target, taken`` and ``source_key``.
    Null sizes count as 0, a null source is a source of its own, a null id has the key of
    an empty id, repeated rows count separately, an empty table gives an empty mix.
    """
    size = F.coalesce(F.col("size"), F.lit(0)).cast("bigint")
    rows = docs.select(
        "doc_id", "source", source_key(F.col("source")).alias("source_key"), size.alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    ).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = rows.groupBy("source_key", "slice").agg(F.sum("size").alias("slice_size"))
    sources = slices.groupBy("source_key").agg(F.sum("slice_size").alias("source_size"))
    if weights is None:
        weights = cyclic_weights(sources.select("source_key"))
    plan = targets(sources.join(weights, "source_key"), share, most)
    earlier = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(
        "source_key", "slice", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0).cast("bigint")).alias("start")
    ).join(plan, "source_key")
    inside = Window.partitionBy("source_key", "slice").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(starts, ["source_key", "slice"]).withColumn(
        "place", F.col("start") + F.sum("size").over(inside) - F.col("size"))
    budget = F.floor("target")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("place")))
    rows = rows.withColumn("budget", budget).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("bigint"))
    return rows.select(
        "doc_id", "source", "source_key", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + cut).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, as it stands."""
    pieces = F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: documents (doc_id, source, text and others), a row for each time one is taken.

    The same columns and ``mix_epoch`` (1, 2, ...), ``mix_target`` (of the source, in words) and
    ``mix_taken`` (words of this row); where a given column has such a name, the added one gets
    underscores before it.  The last document of a source may give only its first words, and its
    text ends there, so the words of a source's rows add up to the whole part of its target.
    Documents without words are not taken.  A null source is a source of its own, repeated rows
    count separately; a very long text is cut by its words like any other.
    A document is found again by its id, source and size; repeated rows are alike.
    """
    source, size, copy, epoch, target, words = (free_name(docs, n) for n in ("mix_source", "mix_size", "mix_copy", "mix_epoch", "mix_target", "mix_taken"))
    taken = mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    # Rows that agree in all three are alike but for the one on the border: number them.
    same = Window.partitionBy("doc_id", source, size).orderBy(F.desc(words))
    plan = taken.select("doc_id", F.col("source_key").alias(source), F.col("size").alias(size), F.col("target").alias(target), F.col("taken").alias(words))
    plan = plan.withColumn(copy, F.row_number().over(same)).withColumnRenamed("doc_id", "plan_id")
    mine = Window.partitionBy("doc_id", source, size).orderBy(F.xxhash64("text"))
    rows = docs.withColumn(source, source_key(F.col("source"))).withColumn(size, n_words(F.col("text")))
    rows = rows.withColumn(copy, F.row_number().over(mine))
    on = [rows["doc_id"].eqNullSafe(plan["plan_id"]), *(rows[c] == plan[c] for c in (source, size, copy))]
    given = [rows[f"`{c.replace('`', '``')}`"] for c in docs.columns]
    found = rows.join(plan, on).where(plan[words] > 0).select(*given, rows[size], plan[target], plan[words])
    found = found.withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col(words) / F.col(size)))))
    own = F.least(F.col(size), F.col(words) - (F.col(epoch) - 1) * F.col(size))
    text = F.when(own < F.col(size), first_words(F.col("text"), own)).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else col for c, col in zip(docs.columns, columns_of(docs), strict=True)], epoch, target, own.alias(words))
