"""Near duplicates among embeddings: cross-polytope hashing, tight balls, verified pairs.

Vectors are rotated by fast Hadamard transforms with random signs; the largest coordinates of
the rotated vector, with their signs, are its bucket.  Every vector goes to the bucket nearest
to it and to the next ones (multiprobe) in each of several tables, so that two vectors at the
threshold share a bucket nearly always.

Dense groups never become all their pairs.  Vectors that share many buckets form a ball around
their centre; by the triangle inequality of angles, members within half the linking angle of
the centre are all linked with each other, and two balls are linked wholly or not at all when
their centres are near or far enough.  Only what these bounds leave open is compared member by
member, in blocks, and only counts leave those blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from tallybook.llm.common import map_batches
from tallybook.llm.neardup import components
from tallybook.session import materialize

#: Buckets that one vector visits in a table.
PROBES = 9
#: Coordinates of a rotated vector that probes may replace the largest one by.
CHOICES = 4
#: Buckets that a vector shares with its leader at least; vectors far apart share one by chance.
SHARED = 3
#: Units of at most so many nodes are compared together.
SMALL = 12
#: Angles are safe to this much; what lies closer to the threshold is compared exactly.
MARGIN = 1e-6


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), of unchanged length."""
    n, size, step = *rows.shape, 1
    while step < size:
        pairs = rows.reshape(n, size // (2 * step), 2, step)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(n, size)
        step *= 2
    return rows / np.float32(math.sqrt(size))


def buckets(rows: np.ndarray, table: int, parts: int, probes: int = PROBES) -> np.ndarray:
    """The ``probes`` buckets of each row (unit vectors) in a table, nearest first.

    A bucket names ``parts`` signed coordinates, each the largest after three rounds of random
    signs and a Hadamard transform.  Probes take the next largest ones, in the order of the
    squares of what the replaced coordinates lose.
    """
    d = rows.shape[1]
    size = max(CHOICES, 1 << max(0, d - 1).bit_length())
    padded = np.zeros((len(rows), size), np.float32)
    padded[:, :d] = rows
    code, loss = np.zeros((len(rows), 1), np.int64), np.zeros((len(rows), 1), np.float32)
    chosen = np.indices((CHOICES,) * parts).reshape(parts, -1)
    for part in range(parts):
        turned = padded
        for signs in np.random.default_rng([table, part, size]).choice(np.array([-1, 1], np.float32), (3, size)):
            turned = hadamard(turned * signs)
        height = np.abs(turned)
        first = np.argpartition(-height, CHOICES - 1, axis=1)[:, :CHOICES]
        first = np.take_along_axis(first, np.argsort(-np.take_along_axis(height, first, 1), axis=1, kind="stable"), 1)
        tall = np.take_along_axis(height, first, 1)
        names = 2 * first + (np.take_along_axis(turned, first, 1) < 0)
        code = code * (2 * size) + names[:, chosen[part]]
        loss = loss + (tall[:, :1] - tall)[:, chosen[part]] ** 2
    return np.take_along_axis(code, np.argsort(loss, axis=1, kind="stable")[:, :probes], 1)


def hash_plan(n: int, d: int, cosine: float, miss: float) -> tuple[int, int]:
    """Parts of a bucket's name and tables for ``n`` vectors of ``d`` dimensions.

    Enough parts for less than half a random vector a bucket.  Tables until a pair just at the
    threshold shares no bucket with a chance of at most ``miss``, by the rate at which random
    pairs at that angle meet (2,000 of them up to 2,048 dimensions, a fixed seed).
    """
    size = max(CHOICES, 1 << max(0, d - 1).bit_length())
    parts = max(1, math.ceil(math.log(max(2, 2 * PROBES * n)) / math.log(2 * size)))
    parts = min(parts, int(62 // math.log2(2 * size)), 7)  # a bucket's name is one long
    rng = np.random.default_rng(d)
    a, b = rng.normal(size=(2, max(50, min(2000, 2**22 // d)), d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-30)
    b = cosine * a + math.sqrt(1 - cosine * cosine) * b
    met = np.mean([(buckets(a, t, parts)[:, :, None] == buckets(b, t, parts)[:, None, :]).any((1, 2)).mean() for t in range(4)])
    return parts, max(1, math.ceil(math.log(miss) / math.log(max(1e-9, 1 - met)))) if met < 1 else 1


def _unit(column: pa.Array) -> np.ndarray:
    """Equally long vectors as rows of length 1, in doubles."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and unit vectors of the rows of each length."""
    sizes = np.asarray(column.value_lengths())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, _unit(column.take(pa.array(at)))


def comparable(vector: str) -> Column:
    """True for vectors that have a direction: finite entries, none null, not all zero."""
    entries = F.col(vector)
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(entries, lambda c: c != 0), F.lit(False))


def vector_classes(rows: DataFrame) -> DataFrame:
    """(num, h1, h2, name, copies, vec): one row per different vector, with its smallest id.

    Vectors are told apart by 128 bits of hash; the table is written, so the numbers stay.
    """
    return materialize(rows.groupBy("h1", "h2").agg(
        F.min("id").alias("name"), F.count(F.lit(1)).alias("copies"), F.any_value("vec").alias("vec"),
    ).withColumn("num", F.monotonically_increasing_id()))


def bucket_keys(classes: DataFrame, plans: dict[int, tuple[int, int]]) -> DataFrame:
    """(num, d, t, bucket): the buckets of each vector, by length and table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, unit in _by_length(batch.column(1)):
                parts, tables = plans[d]
                nums = np.asarray(batch.column(0))[at]
                step = max(1, 2**21 // max(d, CHOICES**parts))
                for low in range(0, len(at), step):
                    for table in range(tables):
                        found = buckets(unit[low : low + step], table, parts)
                        own = np.repeat(nums[low : low + step], found.shape[1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own), pa.array(np.full(len(own), d), pa.int32()), pa.array(np.full(len(own), table), pa.int32()), pa.array(found.ravel())],
                            names=["num", "d", "t", "bucket"])

    return materialize(map_batches(classes.select("num", "vec"), work, "num bigint, d int, t int, bucket bigint"))


def leaders(keys: DataFrame) -> DataFrame:
    """(num, ball): for each vector in a shared bucket the leader that most of its buckets have.

    A bucket is led by its smallest number.  Each vector meets its buckets' leaders only.
    """
    shared = keys.groupBy("d", "t", "bucket").agg(F.min("num").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = keys.join(shared, ["d", "t", "bucket"]).groupBy("num", "leader").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED)
    return met.groupBy("num").agg(F.max(F.struct("n", -F.col("leader")))["col2"].alias("minus")).select("num", (-F.col("minus")).alias("ball"))


def _sums_by_ball(rows: DataFrame) -> DataFrame:
    """(ball, total): sum of the unit vectors of each ball, added up in tasks first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, unit in _by_length(batch.column(1)):
                balls, place = np.unique(np.asarray(batch.column(0))[at], return_inverse=True)
                total = np.zeros((len(balls), unit.shape[1]))
                np.add.at(total, place, unit)
                yield pa.RecordBatch.from_arrays([pa.array(balls), pa.array(list(total), pa.list_(pa.float64()))], names=["ball", "total"])

    def merge(rows: pa.Table) -> pa.Table:
        total = np.sort(np.array(rows["total"].to_pylist()), axis=0).sum(0)
        return pa.table({"ball": rows["ball"][:1].combine_chunks(), "total": pa.array([total], pa.list_(pa.float64()))})

    schema = "ball bigint, total array<double>"
    return map_batches(rows.select("ball", "vec"), work, schema).groupBy("ball").applyInArrow(merge, schema)


def with_nodes(classes: DataFrame, keys: DataFrame, cosine: float) -> DataFrame:
    """(num, node, center, angle): the ball of each vector, or the vector alone.

    A ball (a negative node) holds vectors within half the linking angle of its centre, so
    all of them are linked.  Centres only decide what is compared, never what is linked.
    """
    half = math.acos(cosine) / 2 - MARGIN
    led = materialize(classes.join(leaders(keys), "num").select("num", "ball", "vec"))
    sizes = led.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    led = led.join(sizes, "ball")
    placed = led.join(_sums_by_ball(led), "ball").select("num", "ball", "vec", "total")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = np.full(len(batch), np.inf)
            center = [None] * len(batch)
            for _, at, unit in _by_length(batch.column(2)):
                totals = batch.column(3).take(pa.array(at))
                fits = np.asarray(totals.value_lengths()) == unit.shape[1]
                at, unit, totals = at[fits], unit[fits], totals.filter(pa.array(fits))
                total = totals.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                size = np.linalg.norm(total, axis=1, keepdims=True)
                middle = total / np.where(size > 0, size, 1)
                angle[at] = np.where(size[:, 0] > 0, angles((unit * middle).sum(1)), np.inf)
                for i, row in zip(at.tolist(), middle, strict=True):
                    center[i] = row
            near = angle <= half
            balls = np.asarray(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(near)), pa.array(-1 - balls[near]), pa.array([center[i] for i in np.flatnonzero(near)], pa.list_(pa.float64())), pa.array(angle[near])],
                names=["num", "node", "center", "angle"])

    cores = map_batches(placed, work, "num bigint, node bigint, center array<double>, angle double")
    alone = F.coalesce("node", "num").alias("node")
    return materialize(classes.join(cores, "num", "left").select("num", "copies", "name", "vec", alone, "center", F.coalesce("angle", F.lit(0.0)).alias("angle")))


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def node_table(members: DataFrame) -> DataFrame:
    """(node, size, n, name, center, radius) of balls and single vectors."""
    balls = members.where("node < 0").groupBy("node").agg(
        F.sum("copies").alias("size"), F.count(F.lit(1)).alias("n"), F.min("name").alias("name"), F.any_value("center").alias("center"), F.max("angle").alias("radius"))
    single = members.where("node >= 0").select(
        "node", F.col("copies").alias("size"), F.lit(1).cast("bigint").alias("n"), "name", F.col("vec").cast("array<double>").alias("center"), F.lit(0.0).alias("radius"))
    return materialize(balls.unionByName(single))


def near_nodes(keys: DataFrame, members: DataFrame, nodes: DataFrame, cosine: float, block: int) -> DataFrame:
    """(a, b, whole): different nodes that a bucket shares and that may be linked.

    ``whole`` if every member of one is linked with every member of the other, which is certain
    for two single vectors.  The nodes of a bucket are compared in blocks of about ``block``,
    pairs of blocks in different tasks; only pairs that stay leave a task.
    """
    theta = math.acos(cosine)
    bucket = ["d", "t", "bucket"]
    held = keys.join(members.select("num", "node"), "num").select(*bucket, "node").distinct()
    shared = held.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = held.join(shared.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), bucket)
    held = held.withColumn("mine", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    # Units that share a hash are compared with each other as well, which loses nothing.
    units = held.select(F.xxhash64(*bucket, low, high).alias("unit"), F.when(low == high, 0).when(F.col("mine") == low, 1).otherwise(2).alias("side"), "node")
    rows = units.join(nodes.select("node", "center", "radius"), "node").repartition("unit").sortWithinPartitions("unit")

    def judged(node: np.ndarray, radius: np.ndarray, cosines: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        reach, away = radius[a] + radius[b], angles(cosines)
        whole = np.where(reach == 0, cosines >= cosine, away + reach <= theta - MARGIN)
        kept = whole | (reach > 0) & (away - reach <= theta + MARGIN)
        a, b = node[a[kept]], node[b[kept]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(whole[kept])], names=["a", "b", "whole"])

    def compared(part: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, side, node, radius = (np.asarray(part[c].combine_chunks()) for c in ("unit", "side", "node", "radius"))
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        sizes = np.diff(np.r_[starts, len(unit)])
        small = np.repeat(sizes <= SMALL, sizes)
        for d, at, vectors in _by_length(part["center"].combine_chunks()):
            where = np.full(len(unit), -1)
            where[at] = np.arange(len(at))
            for step in range(1, SMALL):  # all pairs of all small units at once
                a = at[at + step < len(unit)]
                b = a + step
                meet = small[a] & (unit[a] == unit[b]) & (where[b] >= 0) & ((side[a] == 0) | (side[a] != side[b]))
                a, b = a[meet], b[meet]
                yield judged(node, radius, np.einsum("ij,ij->i", vectors[where[a]], vectors[where[b]]), a, b)
            for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                mine = np.arange(start, start + size)
                mine = mine[where[mine] >= 0]
                a, b = np.nonzero(np.triu((side[mine][:, None] == 0) | (side[mine][:, None] != side[mine][None, :]), 1))
                cosines = vectors[where[mine]] @ vectors[where[mine]].T
                yield judged(node, radius, cosines[a, b], mine[a], mine[b])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if left is None else pa.concat_tables([left, part])
            unit = np.asarray(part["unit"].combine_chunks())
            last = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0  # the last unit may go on
            if last:
                yield from compared(part[:last])
            left = part[last:]
        if left is not None and len(left):
            yield from compared(left)

    found = map_batches(rows, work, "a bigint, b bigint, whole boolean")
    return materialize(found.groupBy("a", "b").agg(F.max("whole").alias("whole")))


def open_links(near: DataFrame, members: DataFrame, nodes: DataFrame, cosine: float, block: int) -> DataFrame:
    """(num, host, other, n): members of nodes whose bounds leave links open, compared exactly.

    Of two nodes the one with more members is the host; its members meet those of all its open
    neighbours in blocks.  A row says that vector ``num`` is linked with ``n`` rows of the other
    side, and ``other`` is its own node (a neighbour of ``host``), or null on the host's side.
    """
    sizes = nodes.select("node", "n")
    asked = near.where("not whole").select("a", "b")
    asked = asked.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    first = F.col("na") >= F.col("nb")
    asked = materialize(asked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node")))
    rows = members.select("num", "copies", "vec", "node")
    guests = asked.join(rows, "node").select("host", "num", "copies", "vec", F.col("node").alias("other"))
    hosts = asked.select(F.col("host").alias("node")).distinct().join(rows, "node").select(
        F.col("node").alias("host"), "num", "copies", "vec", F.lit(None).cast("bigint").alias("other"))
    blocks = guests.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cols")).join(
        hosts.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("rows")), "host")
    both = hosts.unionByName(guests).join(blocks, "host")
    mine = F.when(F.col("other").isNull(), F.expr("pmod(xxhash64(num), rows)")).otherwise(F.expr("pmod(xxhash64(num), cols)")).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.when(F.col("other").isNull(), F.col("cols")).otherwise(F.col("rows")) - 1))
    both = both.withColumn("mine", mine).withColumn("met", met)
    own, across = F.when(F.col("other").isNull(), F.col("mine")).otherwise(F.col("met")), F.when(F.col("other").isNull(), F.col("met")).otherwise(F.col("mine"))
    units = both.select("host", own.alias("r"), across.alias("c"), "num", "copies", "other", "vec")

    def work(unit: pa.Table) -> pa.Table:
        other = unit["other"].combine_chunks()
        guest = ~np.asarray(other.is_null())
        vectors = _unit(unit["vec"].combine_chunks())
        nums, copies = (np.asarray(unit[c].combine_chunks()) for c in ("num", "copies"))
        linked = vectors[~guest] @ vectors[guest].T >= cosine
        n = np.zeros(len(unit), np.int64)
        n[~guest], n[guest] = linked @ copies[guest], copies[~guest] @ linked
        return pa.table({"num": nums, "host": unit["host"].combine_chunks(), "other": other, "n": n}).filter(pa.array(n > 0))

    return materialize(units.groupBy("host", "r", "c").applyInArrow(work, "num bigint, host bigint, other bigint, n bigint"))


def near_duplicates(rows: DataFrame, cosine: float = 0.95, miss: float = 1e-4, block: int = 256) -> DataFrame:
    """Vectors (vec_id, embedding) to ``vec_id, n_links, component_id, kept``.

    Two vectors are linked if their cosine, in doubles, is at least ``cosine``; ``n_links``
    counts the other rows linked directly, a component is named by its smallest ``vec_id`` and
    that row is kept.  No link below the threshold is ever made; a pair just at it is missed
    with a chance of about ``miss``, nearer ones far less (see :func:`hash_plan`).

    Vectors that are null, empty, zero, or hold entries that are null or not finite are linked
    with nothing, as are vectors of different lengths.  Equal vectors (also repeated rows) are
    one from the start and linked with each other.  A null id counts as the smallest; ids may
    repeat; other columns are ignored.  An empty table gives an empty result.
    """
    lowest = -(2**63)
    kind = rows.schema["embedding"].dataType
    kind = kind if kind in (ArrayType(FloatType()), ArrayType(DoubleType())) else ArrayType(DoubleType())
    given = rows.select(F.coalesce(F.col("vec_id").cast("bigint"), F.lit(lowest)).alias("id"), F.col("embedding").cast(kind).alias("vec"))
    good = given.where(comparable("vec")).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    classes = vector_classes(good)
    lengths = classes.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a length
    plans = {r.d: hash_plan(r.n, r.d, cosine, miss) for r in lengths}
    keys = bucket_keys(classes, plans)
    members = with_nodes(classes, keys, cosine)
    nodes = node_table(members)
    near = near_nodes(keys, members, nodes, cosine, block)
    opened = open_links(near, members, nodes, cosine, block)

    whole = near.where("whole").select("a", "b")
    edges = whole.union(opened.where("other is not null").select("host", "other").distinct())
    labels = components(edges.toDF("a", "b"), nodes.select(F.col("node").alias("num"), "name"))
    both = whole.union(whole.select("b", "a")).toDF("node", "partner")
    sizes = nodes.select(F.col("node").alias("partner"), F.col("size").alias("far"))
    outside = both.join(sizes, "partner").groupBy("node").agg(F.sum("far").alias("far"))
    counted = opened.groupBy("num").agg(F.sum("n").alias("extra"))
    named = nodes.select("node", "size", "name").join(outside, "node", "left").join(
        labels.select(F.col("num").alias("node"), F.col("label.name").alias("least")), "node", "left").select(
        "node", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("links"), F.coalesce("least", "name").alias("component"))
    by_vector = classes.select("num", "h1", "h2").join(members.select("num", "node"), "num").join(named, "node").join(counted, "num", "left").select(
        "h1", "h2", (F.col("links") + F.coalesce("extra", F.lit(0))).alias("links"), "component")
    found = good.select("id", "h1", "h2").join(by_vector, ["h1", "h2"]).select("id", "links", "component")
    alone = given.where(~comparable("vec")).select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    return found.union(alone).select(
        F.nullif("id", F.lit(lowest)).alias("vec_id"), F.col("links").alias("n_links"), F.nullif("component", F.lit(lowest)).alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"))
