"""Merkle manifest of a table: places by rank in id bitmaps, levels by keyed slot arrays.

No global sort and no window over the rows of a language: a row's place among the rows of its
language is a rank query against that language's compressed bitmap of ids, whose popcount
directory has four levels of bounded fan-out.  ``2 ** bits`` neighbouring nodes then form one
keyed slot array, which reduces ``bits`` levels in one task, so that any table needs a handful
of passes over shrinking tables of nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallybook.operators.ranking import numbered
from tallybook.session import materialize

#: Words of the bitmaps hold 64 ids; a null id lies in a word of its own before all others.
NO_ID = -(1 << 57) - 1

#: Directory levels above a word: blocks of 2**16 ids, then of 2**32 and 2**48.  The shift
#: leads from one level to the next, so nothing has more than 2**16 children.
SHIFTS = (10, 16, 16)


def _part(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 (lowercase hex) of a document's five fields, each with its length."""
    return F.sha2(F.concat(*[_part(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to.

    An entry of ``path`` is ``L`` or ``R`` (the side of the sibling) and the sibling's digest,
    or empty where a node has no sibling and is hashed alone.
    """
    def step(digest: Column, entry: Column) -> Column:
        other = F.substring(entry, 2, 64)
        pair = F.when(entry.startswith("L"), F.concat(other, digest)).otherwise(F.concat(digest, other))
        return F.sha2(pair, 256)

    return F.aggregate(path, leaf, step)


def path_digest(path: Column) -> Column:
    """SHA-256 of a path's sibling digests, from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(path, lambda e: F.substring(e, 2, 64)), ""), 256)


def id_bitmaps(rows: DataFrame) -> DataFrame:
    """(lang_key, word): one bitmap per language, compressed to its 64-bit words that aren't empty.

    ``bits`` has a bit for each id, ``n`` counts rows (more than bits where ids repeat), and
    ``before`` is the directory's answer: rows of the language in all words before.  Bits and
    counts are merged from partial aggregates.  Each level of the directory adds up the counts
    below it; running sums only go over the at most 65,536 children of one parent.
    """
    words = rows.groupBy("lang_key", "word").agg(
        F.expr("bit_or(shiftleft(1L, low))").alias("bits"), F.count(F.lit(1)).alias("n"))
    levels = [words.select("lang_key", "word", "n").withColumnRenamed("word", "at")]
    for shift in SHIFTS:
        above = levels[-1].select("lang_key", F.shiftright("at", shift).alias("at"), "n")
        levels.append(above.groupBy("lang_key", "at").agg(F.sum("n").alias("n")))
    before = None
    for level, shift in zip(reversed(levels), (None, *reversed(SHIFTS)), strict=True):
        parent = F.lit(0) if shift is None else F.shiftright("at", shift)
        level = level.withColumn("parent", parent.cast("bigint"))
        earlier = Window.partitionBy("lang_key", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        if before is not None:
            above = before.select("lang_key", F.col("at").alias("parent"), F.col("before").alias("base"))
            level = level.join(above, ["lang_key", "parent"]).withColumn("before", F.col("before") + F.col("base"))
        before = level.select("lang_key", "at", "before")
    return words.join(before.withColumnRenamed("at", "word"), ["lang_key", "word"])


def _repeated_places(crowded: DataFrame) -> DataFrame:
    """Places of the rows of words in which some id repeats.

    Rows of one id are ordered by their digests.  Equal rows are counted first; what differs
    is cut into slices by the first three signs of the digest, so that no task holds all rows
    of one id.
    """
    keys = ["lang_key", "word", "low", "doc_id"]
    counted = crowded.withColumn("slice", F.substring("leaf", 1, 3)).groupBy(
        *keys, "before", "slice", "leaf", "tampered").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("lang_key", "word", "low", "slice").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    slices = counted.groupBy("lang_key", "word", "low", "slice").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("lang_key", "word").orderBy("low", "slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("lang_key", "word", "low", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("outside"))
    placed = counted.join(slices, ["lang_key", "word", "low", "slice"])
    start = F.col("before") + F.col("outside") + F.col("inside")
    # Copies become rows again in pieces, which the exchange between deals out.
    pieces = placed.select("lang_key", "doc_id", "leaf", "tampered", (start + F.col("n")).alias("end"),
                           F.explode(F.sequence(start, start + F.col("n") - 1, F.lit(4096).cast("bigint"))).alias("first"))
    pieces = pieces.repartition("lang_key", "first")
    return pieces.select("lang_key", F.explode(F.sequence("first", F.least(F.col("first") + 4095, F.col("end") - 1))).alias("slot"),
                         "doc_id", "leaf", "tampered")


def with_slots(rows: DataFrame) -> DataFrame:
    """Rows (lang_key, doc_id, leaf, tampered) with their ``slot`` among the rows of the language.

    Ids ascend, null first; rows of one id follow their digests.
    """
    placed = rows.withColumns({
        "word": F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_ID)),
        "low": F.coalesce(F.col("doc_id").bitwiseAND(63), F.lit(0)).cast("int")})
    maps = id_bitmaps(placed.select("lang_key", "word", "low"))
    found = placed.join(maps, ["lang_key", "word"])
    # Only the bits up to the row's own one, which is set, stay.
    below = F.expr("bit_count(shiftleft(bits, 63 - low)) - 1")
    found = materialize(found.select(
        "lang_key", (F.col("before") + below).alias("slot"), "doc_id", "leaf", "tampered", "word", "low", "before",
        (F.col("n") > F.bit_count("bits")).alias("crowded")))
    own = found.where("not crowded").select("lang_key", "slot", "doc_id", "leaf", "tampered")
    return own.unionByName(_repeated_places(found.where("crowded")))


def _levels(digests: list[str], bits: int) -> list[list[str]]:
    """The levels over a slot array, at most ``bits`` of them, down to one node."""
    levels = [digests]
    while len(levels) <= bits:
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + 2]).encode()).hexdigest() for i in range(0, len(below), 2)])
    return levels


def _slot_array(slots: list[int], digests: list[str], bits: int) -> list[str]:
    """Digests put into their slots of one run."""
    out = [""] * len(slots)
    for slot, digest in zip(slots, digests, strict=True):
        out[slot & ((1 << bits) - 1)] = digest
    return out


def reduce_level(nodes: DataFrame, bits: int) -> DataFrame:
    """(lang_key, slot, n, digest): the nodes ``bits`` levels up, one per run of slots.

    ``n`` counts the language's nodes on a level.  A language's last run stops at its top:
    only as many levels are reduced as the language has.
    """
    def work(run: pa.Table) -> pa.Table:
        slots = run["slot"].to_pylist()
        top = height(run["n"][0].as_py(), bits)
        digest = _levels(_slot_array(slots, run["digest"].to_pylist(), bits), top)[-1][0]
        above = -(-run["n"][0].as_py() // (1 << bits))
        return pa.table({"lang_key": run["lang_key"][:1].combine_chunks(), "slot": pa.array([slots[0] >> bits], pa.int64()),
                         "n": pa.array([above], pa.int64()), "digest": pa.array([digest])})

    runs = nodes.select("lang_key", F.shiftright("slot", bits).alias("run"), "slot", "n", "digest")
    return runs.groupBy("lang_key", "run").applyInArrow(work, "lang_key string, slot bigint, n bigint, digest string")


def height(n: int, bits: int) -> int:
    """Levels above ``n`` nodes until one is left, at most ``bits``."""
    return min(bits, (n - 1).bit_length())


def with_paths(nodes: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """``nodes`` (lang_key, run, slot, n, digest, ...) with the path of each to the root.

    A run's slot array gives the siblings inside it; ``above`` (lang_key, run, upper) the rest,
    one row per run.  Both meet by key.
    """
    names = [c for c in nodes.columns if c not in ("run", "n")]

    def work(run: pa.Table, upper: pa.Table) -> pa.Table:
        rest = upper["upper"][0].as_py() if len(upper) else []
        slots = run["slot"].to_pylist()
        levels = _levels(_slot_array(slots, run["digest"].to_pylist(), bits), height(run["n"][0].as_py(), bits))
        paths = []
        for slot in slots:
            at, path = slot & ((1 << bits) - 1), []
            for level in levels[:-1]:
                other = at ^ 1
                path.append(("L" if at & 1 else "R") + level[other] if other < len(level) else "")
                at >>= 1
            paths.append(path + rest)
        return run.select(names).append_column("path", pa.array(paths, pa.list_(pa.string())))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema if f.name in names)
    return nodes.groupBy("lang_key", "run").cogroup(above.groupBy("lang_key", "run")).applyInArrow(work, f"{kinds}, path array<string>")


def forest(leaves: DataFrame, most: int, bits: int) -> list[DataFrame]:
    """The levels of nodes over ``leaves`` (lang_key, slot, n, digest), each ``bits`` above the last.

    ``most`` is the largest ``n``; it alone decides how many there are.
    """
    levels = [leaves]
    while most > 1:
        levels.append(materialize(reduce_level(levels[-1], bits)))
        most = -(-most // (1 << bits))
    return levels


def paths_of(levels: list[DataFrame], top: DataFrame, bits: int) -> DataFrame:
    """The first level's nodes with their paths; ``top`` (lang_key, path) continues each language's."""
    *below, last = levels
    above = last.select("lang_key", F.col("slot").alias("run")).join(top, "lang_key").withColumnRenamed("path", "upper")
    for place, level in enumerate(reversed(below)):
        level = level.withColumn("run", F.shiftright("slot", bits))
        level = with_paths(level, above, bits)
        if place < len(below) - 1:
            above = materialize(level.select("lang_key", F.col("slot").alias("run"), F.col("path").alias("upper")))
    return level if below else levels[0].drop("n").join(top, "lang_key")


def manifest(docs: DataFrame, tampered: Column | None = None, bits: int = 9) -> DataFrame:
    """Documents (doc_id, source, lang, n_chars, text) to ``doc_id, leaf, subroot, root, path, tampered``.

    Every row is a leaf.  The leaves of a language ascend by ``doc_id``; every two consecutive
    nodes (the last one alone if their number is odd) are hashed into one until one is left,
    the language's ``subroot``.  The subroots, by language (null first, then by UTF-8 bytes),
    are reduced alike to ``root``.  ``path`` lists a leaf's siblings up to the root, see
    :func:`fold`.  ``tampered`` is carried along (a digest that :func:`fold` may start from).

    Null fields count as ``-``, an empty text as ``0:``; null ids come first in their language;
    rows of one id follow their digests, and equal rows are leaves of their own.  Texts of any
    length are hashed in the scan and never moved.  Without rows there is no root and no row.
    Ids must be integers; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be an integer column, not {kind.simpleString()}")
    digest = leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("/"), "lang"), F.lit("")).alias("lang_key"), F.col("doc_id").cast("bigint").alias("doc_id"),
        digest.alias("leaf"), (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"))
    slots = materialize(with_slots(rows))
    sizes = slots.groupBy("lang_key").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes)
    most = sizes.agg(F.max("n")).first()[0] or 0
    leaves = slots.join(sizes, "lang_key").withColumnRenamed("leaf", "digest")
    trees = forest(leaves.select("lang_key", "slot", "n", "digest"), most, bits)
    subroots = materialize(trees[-1].select("lang_key", F.col("digest").alias("subroot")))

    # The tree over the languages is one more forest, of a single tree.
    langs = subroots.count()
    ranked = numbered(subroots.withColumn("all", F.lit("")), ["all"], ["lang_key"])
    tops = materialize(ranked.select(F.lit("").alias("lang_key"), (F.col("rank") - 1).cast("bigint").alias("slot"),
                                     F.lit(langs).cast("bigint").alias("n"), F.col("subroot").alias("digest"), F.col("lang_key").alias("lang")))
    upper = forest(tops.select("lang_key", "slot", "n", "digest"), langs, bits)
    root = (upper[-1].first() or {"digest": None})["digest"]  # one value
    none = slots.sparkSession.range(1).select(F.lit("").alias("lang_key"), F.array().cast("array<string>").alias("path"))
    ends = paths_of([tops, *upper[1:]], none, bits).select(F.col("lang").alias("lang_key"), "path")
    ends = materialize(ends)

    found = paths_of([leaves, *trees[1:]], ends, bits)
    found = found.join(subroots, "lang_key").withColumn("root", F.lit(root).cast("string"))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "tampered")
