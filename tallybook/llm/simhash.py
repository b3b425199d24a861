"""SimHash fingerprints of whole texts, and all fingerprints within a Hamming radius."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import WordHashes, map_batches, mixed, words_of

BITS = 256
#: A term's weight is this many times (1 + ln(count)), rounded, so that sums are exact.
WEIGHT_SCALE = 16


def votes(hashes: np.ndarray, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Sums of weights of terms whose hash has a bit set minus those whose hash has not."""
    streams = [mixed(hashes + np.uint64(s)) for s in range(bits // 64)]
    planes = np.unpackbits(np.stack(streams, 1).view(np.uint8).reshape(len(hashes), -1), axis=1)
    kind = np.float32 if int(weights.sum()) < 1 << 23 else np.float64  # whole numbers are exact
    return 2 * (weights.astype(kind) @ planes.astype(kind)) - weights.sum().astype(kind)


def terms(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and pairs of neighbouring words, and their weights."""
    pairs = mixed(mixed(hashes[:-1]) + hashes[1:])
    found, counts = np.unique(np.concatenate([hashes, pairs]), return_counts=True)
    return found, np.rint(WEIGHT_SCALE * (1 + np.log(counts))).astype(np.int64)


def fingerprint(text: str | None, known: WordHashes, bits: int = BITS) -> bytes:
    """The bits with a positive vote, first bit first; all zero without words."""
    words = words_of(text)
    if not words:
        return bytes(bits // 8)
    return np.packbits(votes(*terms(known.of(words)), bits) > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def fingerprints(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Documents (doc_id, text) to ``doc_id, fingerprint`` (hex).

    Terms are words and pairs of words of the whole text with A-Z in lower case, weighted
    by 1 + ln(count).  Null, empty and blank texts have the all-zero fingerprint; repeated
    rows give repeated results; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            prints = [fingerprint(t, known, bits).hex() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {id_type}, fingerprint string")


def hamming(a: Column, b: Column, bits: int = BITS) -> Column:
    """Number of different bits of two hex fingerprints."""
    words = [
        F.bit_count(F.conv(F.substring(a, i + 1, 8), 16, 10).cast("bigint").bitwiseXOR(
            F.conv(F.substring(b, i + 1, 8), 16, 10).cast("bigint")))
        for i in range(0, bits // 4, 8)
    ]
    return sum(words[1:], words[0])


def within_radius(prints: DataFrame, queries: DataFrame, radius: int, blocks: int | None = None, chosen: int = 1, bits: int = BITS) -> DataFrame:
    """All pairs of a query and a different fingerprint at most ``radius`` bits apart.

    Both tables have one column ``fingerprint`` (hex); equal ones count once, so a group of
    copies is one row (join ``doc_id`` to the fingerprints for membership).  Fingerprints
    are cut into ``blocks`` blocks; for each choice of ``chosen`` blocks a table is keyed by
    these (a permutation that puts them first).  Two fingerprints within the radius agree in
    ``blocks - radius`` blocks at least, so with ``chosen <= blocks - radius`` some table
    brings them together: nothing within the radius is missed.  Pairs meet by an equi-join
    that AQE splits where a block value is frequent, and each counts at its first table only.
    """
    blocks = radius + chosen if blocks is None else blocks
    if chosen > blocks - radius:
        raise ValueError("the tables can miss fingerprints: choose fewer blocks")
    edges = [round(i * bits / 4 / blocks) for i in range(blocks + 1)]
    cut = lambda c, b: F.substring(c, edges[b] + 1, edges[b + 1] - edges[b])
    tables = list(combinations(range(blocks), chosen))
    keyed = lambda df, name: df.select(F.col("fingerprint").alias(name)).distinct().withColumn(
        "key", F.explode(F.array(*[F.concat(F.lit(f"{i}:"), *[cut(F.col(name), b) for b in t]) for i, t in enumerate(tables)])))
    pairs = keyed(queries, "query").join(keyed(prints, "found"), "key").where(F.col("query") != F.col("found"))
    agree = [F.when(F.concat(*[cut(F.col("query"), b) for b in t]) == F.concat(*[cut(F.col("found"), b) for b in t]), i) for i, t in enumerate(tables)]
    first = F.coalesce(*agree)
    distance = hamming(F.col("query"), F.col("found"), bits)
    return pairs.where(F.substring_index("key", ":", 1).cast("int") == first).select(
        "query", "found", distance.alias("distance")).where(F.col("distance") <= radius)


def _blocks(ids: DataFrame, pieces: int) -> tuple[list[float], list[tuple[int, int]]]:
    """Borders of about ``pieces`` blocks of ids, and the largest id of each block in use."""
    shares = [i / pieces for i in range(1, pieces)] or [0.5]
    found = ids.agg(F.percentile_approx("id", shares, max(10_000, 5 * pieces)).alias("ids")).first()["ids"]
    borders = sorted({float(i) for i in found or []})
    heads = _with_block(ids, borders).groupBy("block").agg(F.max("id").alias("head")).orderBy("block").collect()
    return borders, [(r["block"], r["head"]) for r in heads]


def _with_block(df: DataFrame, borders: list[float]) -> DataFrame:
    if not borders:
        return df.withColumn("block", F.lit(0))
    splits = [float("-inf"), *borders, float("inf")]
    kept = [*df.columns, "block"]
    out = Bucketizer(splits=splits, inputCol="_place", outputCol="_block").transform(df.withColumn("_place", F.col("id").cast("double")))
    return out.withColumn("block", F.col("_block").cast("int")).select(*kept)


def with_next(docs: DataFrame, pieces: int) -> DataFrame:
    """Fingerprints of each text, of the next one and of the two halves put together.

    Documents (doc_id, text) are read in descending order of ``doc_id`` (null last; ties
    by length and text), the last is followed by the first.  The edited text has the last
    floor(n / 2) code points replaced by the first as many of the next text.

    Ids are cut into about ``pieces`` blocks (the driver sees one border and one largest id
    of each).  A block is sorted and read as a stream by one task; the first row of each
    block also travels to the block before it, so every text moves once.  Returns
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    A null text counts as empty, a table of one row is its own next, an empty one gives none.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    lowest = F.lit(-(2**63)).cast("bigint")
    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("bigint"), lowest).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    borders, heads = _blocks(rows.select("id"), pieces)
    # The next of a block's last row is the head of the block below; the lowest has the highest.
    serves = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}
    spark = docs.sparkSession
    guests = spark.createDataFrame(list(serves.items()), "id bigint, to int") if heads else spark.createDataFrame([], "id bigint, to int")
    rows = _with_block(rows, borders).join(F.broadcast(guests), "id", "left")
    home = F.struct(F.col("block"), F.lit(0).alias("guest"))
    away = F.struct(F.col("to").alias("block"), F.lit(1).alias("guest"))
    rows = rows.select("doc_id", "id", "text", F.inline(F.when(F.col("to").isNull(), F.array(home)).otherwise(F.array(home, away))))
    rows = rows.repartition("block").sortWithinPartitions("block", "guest", F.desc("id"), F.length("text"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        held = None  # doc_id, text, fingerprint, block
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "block", "guest")]
            for doc_id, text, block, guest in zip(*columns, strict=True):
                if guest and held is None:
                    continue
                mark = fingerprint(text, known)
                if held is not None:
                    mine, own, print_, _ = held
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    new = fingerprint(edited, known)
                    out.append((mine, len(own), hashlib.sha256(edited.encode()).hexdigest(), print_.hex(), new.hex(),
                                likeness(print_, new), likeness(print_, mark)))
                held = None if guest else (doc_id, text, mark, block)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.string() if id_type == "string" else pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = f"doc_id {'string' if id_type == 'string' else 'bigint'}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(rows.select("doc_id", "text", "block", "guest"), work, schema)
