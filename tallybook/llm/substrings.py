"""Exact removal of long byte strings that occur more than once."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import map_batches, mixed
from tallybook.session import materialize, scratch_path

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Powers:
    """Powers of the rolling hash's base and of its inverse, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = 1 << n.bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


def anchors(raw: bytes, length: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start, last start and anchor hash of each stretch of window starts.

    The anchor of a window of ``length`` bytes is its ``gram``-byte string with the smallest
    hash (the leftmost of equal ones), so equal windows have their anchor at one offset.
    """
    n = len(raw)
    powers.grow(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * powers.up[:n], out=total[1:])
    hashes = mixed((total[gram:] - total[:-gram]) * powers.down[: n - gram + 1])
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = length - gram + 1
    # Smallest key of each window of ``width`` keys: from prefixes and suffixes of blocks.
    padded = np.concatenate([keys, np.full(-len(keys) % width, _MASK, np.uint64)]).reshape(-1, width)
    prefix = np.minimum.accumulate(padded, 1).ravel()
    suffix = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - length + 1
    found = (np.minimum(suffix[:starts], prefix[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[first], first, np.append(first[1:] - 1, starts - 1), hashes[found[first]]


def _pack(anchor: int, low: int, high: int) -> int:
    return low << 24 | (high - low) << 12 | (anchor - low)


def _unpack(at: int) -> tuple[int, int, int]:
    low = at >> 24
    return low + (at & 0xFFF), low, low + (at >> 12 & 0xFFF)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


_LEVEL = "parent bigint, child bigint, n bigint, key binary, at array<bigint>"


def _level(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["parent", "child", "n", "key", "at"])


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(key, raw) to a table ``key, raw, copies`` in the shared folder, bucketed by key.

    Copies meet after partial aggregation.  Later joins on the key leave the texts where
    they are.
    """
    spark = rows.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.groupBy("key").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies"))
    found.write.bucketBy(pieces, "key").option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def _suffix_buckets(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Stretches of windows: parent = hash of the anchor's string, child = hash of all their bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        powers = Powers()
        for batch in batches:
            rows = []
            for key, raw, copies in zip(*(batch.column(c).to_pylist() for c in ("key", "raw", "copies")), strict=True):
                if len(raw) < length:
                    continue
                found = defaultdict(list)
                for a, low, high, value in zip(*(x.tolist() for x in anchors(raw, length, gram, powers)), strict=True):
                    found[value, xxhash.xxh3_64_intdigest(raw[low : high + length], a - low)].append(_pack(a, low, high))
                rows += [(_signed(p), _signed(c), 2 if copies > 1 else len(at), key, at) for (p, c), at in found.items()]
            yield _level(rows)

    return materialize(map_batches(texts.select("key", "raw", "copies"), work, _LEVEL))


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, at) of stretches that occur more than once, and (key, at, parent) of those to cut.

    A parent of one child and one row is alone: nothing below it repeats.  Stretches of the
    same child are equal, so all their windows repeat; one of them goes on to be compared
    with the other children of its parent.
    """
    mine = F.xxhash64("key", F.col("at")[0])
    children = rows.groupBy("parent", "child").agg(F.sum("n").alias("total"), F.max(mine).alias("one"))
    parents = children.groupBy("parent").agg(F.sum("total").alias("all"), F.count(F.lit(1)).alias("kinds")).where(F.col("all") > 1)
    known = children.join(parents, "parent").select("parent", "child", "total", "one", "kinds")
    out = materialize(rows.join(known, ["parent", "child"]).where((F.col("total") > 1) | (F.col("kinds") > 1)).select(
        "key", "at", "parent", (F.col("total") > 1).alias("repeats"), ((F.col("kinds") > 1) & (F.col("one") == mine)).alias("cut")))
    return out.where("repeats").select("key", "at"), out.where("cut").select("key", F.col("at")[0].alias("at"), "parent")


def _cut(texts: DataFrame, stretches: DataFrame, step: int, length: int) -> DataFrame:
    """Stretches cut at every ``step``-th offset from their anchor.

    Parent is the hash of the bytes that all windows of a piece share (the sampled string
    whose class settles long ties), child that of all its bytes.
    """
    listed = stretches.groupBy("key").agg(F.collect_list(F.struct("at", "parent")).alias("stretches"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows = []
            for key, raw, found in zip(*(batch.column(c).to_pylist() for c in ("key", "raw", "stretches")), strict=True):
                for stretch in found:
                    a, low, high = _unpack(stretch["at"])
                    for place in range((a - high) // step * step, a - low + 1, step):
                        near, far = max(place, a - high), min(place + step - 1, a - low)
                        shared = raw[a - place : a - place - step + 1 + length]
                        whole = raw[a - far : a - near + length]
                        rows.append((_signed(digest(shared, (stretch["parent"] ^ place) & _MASK)),
                                     _signed(digest(whole, (near - place) << 12 | (far - place))), 1, key, [_pack(a, a - far, a - near)]))
            yield _level(rows)

    rows = texts.join(listed, "key").select("key", "raw", "stretches")
    return materialize(map_batches(rows, work, _LEVEL))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def repeats_by_text(docs: DataFrame, length: int = 400, gram: int = 64, steps: tuple[int, ...] = (32, 4, 1)) -> DataFrame:
    """Each different text once: ``key`` (see :func:`text_key`), ``n_bytes, n_removed, n_spans, kept``.

    Every byte that is covered by a string of ``length`` bytes that also starts anywhere else
    (in any document, the same one included) is removed; strings are judged on the input.
    All starts are compared, blockwise, without a sort of all suffixes:

    1. Equal texts become one (with at least ``length`` bytes all of theirs repeats).
    2. Starts fall into buckets by the string at their anchor; a bucket of one start range
       has no repeat.  Start ranges with equal bytes repeat as a whole.
    3. Within a bucket offsets are aligned, so the cover sample is a grid: the classes of
       the strings at every ``steps``-th offset, taken over all documents, settle long ties.
       Ranges whose sampled string is unique have no repeat, equal ranges repeat as a whole,
       the rest is cut by the next step, down to single starts.

    Classes are pairs of 64-bit hashes.  Null texts count as empty, repeated rows as copies,
    other columns are ignored; texts of any length are read whole.
    """
    if not (0 < gram <= length < 4096 and steps[-1] == 1):
        raise ValueError("gram must fit the length, the length 12 bits, and the last step be 1")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    texts = distinct_texts(docs.select(text_key(F.col("text")).alias("key"), raw.alias("raw")))
    repeats, open_ = _settled(_suffix_buckets(texts, length, gram))
    for step in steps:
        more, open_ = _settled(_cut(texts, open_, step, length))
        repeats = repeats.union(more)
    listed = repeats.select("key", F.explode("at").alias("at")).groupBy("key").agg(F.collect_list("at").alias("found"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw, copies, found in zip(*(batch.column(c).to_pylist() for c in ("key", "raw", "copies", "found")), strict=True):
                n = len(raw)
                if copies > 1 and n >= length:
                    rows.append((key, n, n, 1, b""))
                    continue
                if not found:
                    rows.append((key, n, 0, 0, raw))
                    continue
                edges = np.zeros(n + 1, np.int64)
                for at in found:
                    _, low, high = _unpack(at)
                    edges[low] += 1
                    edges[high + length] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((key, n, int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_batches(texts.join(listed, "key", "left").select("key", "raw", "copies", "found"), work, "key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 64, steps: tuple[int, ...] = (32, 4, 1)) -> DataFrame:
    """Documents (doc_id, text) to ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary).

    One row per row; see :func:`repeats_by_text`.
    """
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    return rows.join(repeats_by_text(docs, length, gram, steps), "key").drop("key")
