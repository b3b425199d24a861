"""Near duplicates by bottom-k sketches: no link is lost, no list is turned into all its pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import WORD, WordHashes, columns_of, free_name, map_batches, shingles, words_of
from tallybook.session import materialize

#: A null id counts as the smallest one.
LOWEST = -(2**63)


def shingle_set(text: str | None, known: WordHashes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words of a whole text."""
    return np.unique(shingles(known.of(words_of(text)), size))


def node_of(found: np.ndarray) -> bytes:
    """128-bit name of a set."""
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def least_shared(n: int, sketch: int, percent: int) -> int:
    """Retained values that the sketch of a set of ``n`` shares with any similar set's.

    Where a sketch holds (nearly) the whole set this is exact.  Else the share of the
    retained values that both have is a draw without replacement with mean ``percent`` at
    least; half of that mean is seven standard deviations below it for 64 values (a chance
    of about 1e-11 for a pair just at the threshold).
    """
    if 100 * n <= percent * sketch:
        return -(-percent * n // 100)
    return percent * sketch // 200


def sketches(docs: DataFrame, size: int, sketch: int) -> DataFrame:
    """Documents (id, text) to ``id, copy, n_shingles, node, values`` in the shared folder.

    ``copy`` is a hash of the text, which tells apart rows of one id.

    ``values`` are the ``sketch`` smallest hashes of the set, from one hash function.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, known, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("copy"), pa.array(map(len, sets), pa.int64(), size=len(sets)), pa.array([node_of(s) for s in sets], pa.binary()),
                 pa.array([s[:sketch].view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["id", "copy", "n_shingles", "node", "values"])

    rows = docs.select("id", "text", F.xxhash64("text").alias("copy"))
    return materialize(map_batches(rows, work, "id bigint, copy bigint, n_shingles bigint, node binary, values array<bigint>"))


def set_classes(sets: DataFrame) -> DataFrame:
    """One row per different set: ``num`` (a short number), ``node``, ``name`` (smallest id), ``copy`` (a text with it), ``n_shingles, values``.

    The table is written, so the numbers stay; copies meet after partial aggregation.
    """
    names = sets.groupBy("node").agg(F.min("id").alias("name"))
    first = sets.join(names, "node").where("id = name").dropDuplicates(["node"])
    return materialize(first.select(F.monotonically_increasing_id().alias("num"), "node", "name", "copy", "n_shingles", "values"))


def inverted_lists(classes: DataFrame, sketch: int, percent: int) -> DataFrame:
    """(value, num, weight): the values by which a set can meet a similar one.

    The retained values of a set are put in order from the rarest to the most frequent.
    Sets that share at least ``least_shared`` of them share one that is not among the last
    ``least_shared - 1`` of either, so these frequent ones (of passages that many documents
    have) are left out without losing a pair; values of one set alone meet nothing.
    ``weight`` is larger for sets whose values are more frequent.
    """
    rows = classes.select("num", F.explode("values").alias("value"))
    often = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = rows.join(often, "value").groupBy("num").agg(
        F.array_sort(F.collect_list(F.struct("n", "value"))).alias("shared"),
        F.sum(F.floor(16 * F.log2("n"))).alias("weight"))
    need = F.when(F.col("n_shingles") * 100 <= percent * sketch, F.ceil(F.col("n_shingles") * percent / 100)).otherwise(percent * sketch // 200)
    held = F.least(F.col("n_shingles"), F.lit(sketch))
    # Values of one set alone come first in its order; they use up the places.
    places = held - need + 1 - (held - F.size("shared"))
    kept = kept.join(classes.select("num", "n_shingles"), "num").withColumn("places", places.cast("int")).where("places > 0")
    return kept.select("num", "weight", F.explode(F.slice("shared", F.lit(1), F.col("places"))).alias("s")).select(
        F.col("s.value").alias("value"), "num", "weight")


def groups_of_lists(lists: DataFrame) -> DataFrame:
    """(leader, num, n): sets that may be similar, in groups of ``n``; in the shared folder.

    Each list is led by its set of the largest weight; all lists of a leader make one
    group, so sets that share many values meet once.
    """
    leaders = lists.groupBy("value").agg(F.max(F.struct("weight", "num"))["num"].alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = lists.select("value", "num").join(leaders.select("value", "leader"), "value").select("leader", "num").distinct()
    return materialize(members.join(members.groupBy("leader").agg(F.count(F.lit(1)).alias("n")), "leader"))


def _unit(*parts: Column | str) -> Column:
    return F.concat_ws("-", *parts).alias("unit")


def _whole_units(groups: DataFrame, name: str) -> DataFrame:
    """(unit, side, num): each group one unit, whose members are all compared with each other."""
    return groups.where("n > 1").select(_unit(F.lit(name), "leader"), F.lit(0).alias("side"), "num")


def _block_units(groups: DataFrame, block: int, name: str) -> DataFrame:
    """(unit, side, num): groups cut into blocks; each pair of blocks is a unit, no pair is a row."""
    blocks = groups.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    blocks = blocks.withColumn("mine", F.expr("cast(pmod(xxhash64(num), blocks) as int)"))
    other = blocks.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return other.select(
        _unit(F.lit(name), "leader", low, high),
        F.when(low == high, 0).when(F.col("mine") == low, 1).otherwise(2).alias("side"), "num")


#: What a set is to the center of its group.
LINKED, NEAR, FAR = 0, 1, 2


def _met_center(groups: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """Groups (leader, num, n, center) to ``leader, center, num, state``; in the shared folder.

    Pieces of a group meet their center in tasks of their own, by the full sets.  Distances
    (one less the similarity) obey the triangle inequality: a set whose distance from the
    center is more than twice the linking distance is ``FAR`` and not similar to any set
    that is linked with the center.
    """
    groups = groups.withColumn("pieces", F.ceil(F.col("n") / block).cast("int"))
    piece = F.when(F.col("num") == F.col("center"), F.expr("sequence(0, pieces - 1)")).otherwise(F.array(F.expr("cast(pmod(xxhash64(num), pieces) as int)")))
    rows = groups.withColumn("piece", F.explode(piece)).select(
        _unit("leader", "piece"), "leader", "center", (F.col("num") != F.col("center")).cast("int").alias("side"), "num")
    rows = rows.join(_full_sets(rows, docs, classes, size), "num").repartition("unit").sortWithinPartitions("unit", "side", "num")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, middle, last = None, None, None
        for batch in batches:
            out = []
            for name, leader, center, side, num, full in zip(
                    *(batch.column(c).to_pylist() for c in ("unit", "leader", "center", "side", "num", "full")), strict=True):
                found = np.frombuffer(full, np.uint64)
                if name != unit:  # a unit begins with its center
                    unit, middle, last = name, found, num
                elif num != last:  # repeated rows give a set twice
                    last = num
                    both = len(np.intersect1d(middle, found, assume_unique=True))
                    union = len(middle) + len(found) - both
                    state = LINKED if 100 * both >= percent * union else FAR if 100 * both < (2 * percent - 100) * union else NEAR
                    out.append((leader, center, num, state))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["leader", "center", "num", "state"])

    kept = rows.select("unit", "leader", "center", "side", "num", "full")
    return materialize(map_batches(kept, work, "leader bigint, center bigint, num bigint, state bigint"))


def _units_of_near(states: DataFrame, block: int, name: str) -> DataFrame:
    """(unit, side, num): sets neither linked with the center nor far, with all of their group."""
    near = F.col("state") == NEAR
    states = states.select("leader", "num", "state", F.col("n_near").alias("n"), (F.col("n") - F.col("n_near")).alias("n_other")).where("n > 0")
    rows = states.withColumn("near", near)
    count = lambda n: F.ceil(F.col(n) / block).cast("int")
    rows = rows.withColumns({"blocks": count("n"), "other_blocks": count("n_other")})
    rows = rows.withColumn("mine", F.expr("cast(pmod(xxhash64(num), if(near, blocks, other_blocks)) as int)"))
    rows = rows.withColumn("met", F.when(F.col("near"), F.col("other_blocks")).otherwise(F.col("blocks"))).where("met > 0")
    rows = rows.withColumn("met", F.explode(F.expr("sequence(0, met - 1)")))
    across = rows.select(
        _unit(F.lit(name + "x"), "leader", F.when(F.col("near"), F.col("mine")).otherwise(F.col("met")), F.when(F.col("near"), F.col("met")).otherwise(F.col("mine"))),
        F.when(F.col("near"), 1).otherwise(2).alias("side"), "num")
    return _block_units(states.where(near), block, name + "n").union(across)


def around_centers(groups: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, block: int, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Groups (leader, num, n) to links (a, b) with centers, and units that are left to compare.

    All sets meet the center of their group.  Those linked with it are joined and need not
    meet each other; far ones meet only each other, around a center of their own; what lies
    between meets everyone.  Near copies of one text so cost their number, not its square.
    What is still a large group after some rounds is compared in blocks.
    """
    links, units, left = [], [], groups.withColumn("center", F.col("leader"))
    for turn in range(rounds):
        states = _met_center(left, docs, classes, size, percent, block)
        links.append(states.where(F.col("state") == LINKED).select(F.col("center").alias("a"), F.col("num").alias("b")))
        sizes = states.groupBy("leader").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == NEAR).alias("n_near"), F.count_if(F.col("state") == FAR).alias("n_far"),
            F.max_by("num", F.when(F.col("state") == FAR, F.xxhash64("num"))).alias("next"))
        states = materialize(states.drop("center").join(sizes.where("n > 1 AND n_near + n_far > 0"), "leader"))
        # A group of one block is one unit: all that is left of it, or its far sets only.
        one = states.where((F.col("n") <= block) & (F.col("n_near") > 0))
        far = states.where((F.col("state") == FAR) & ((F.col("n") > block) | (F.col("n_near") == 0)))
        far = far.select("leader", "num", F.col("n_far").alias("n"), F.col("next").alias("center"))
        units += [_whole_units(one, f"{turn}o"), _whole_units(far.where(F.col("n") <= block), f"{turn}f"),
                  _units_of_near(states.where(F.col("n") > block), block, f"{turn}")]
        left = far.where(F.col("n") > block)
        if left.isEmpty():
            break
    else:
        units.append(_block_units(left, block, "b"))
    return reduce(DataFrame.union, links), reduce(DataFrame.union, units)


def links_of_lists(lists: DataFrame, docs: DataFrame, classes: DataFrame, size: int, sketch: int, percent: int, block: int) -> DataFrame:
    """(a, b): links that join all similar sets, each confirmed on the full sets."""
    links, units = around_centers(groups_of_lists(lists), docs, classes, size, percent, block)
    return links.union(verified_links(materialize(units), docs, classes, size, sketch, percent))


def _links_of_unit(nodes: list[int], sides: list[int], sets: list[np.ndarray], sketch: int, percent: int) -> list[tuple[int, int]]:
    """What similar pairs join in a unit: each joined set with the smallest one it is joined with.

    Stars, not chains of the pairs themselves, so that few rounds name the components.
    """
    n = len(nodes)
    if n < 2:
        return []
    kept = [s[:sketch] for s in sets]
    sizes = np.array([len(s) for s in sets])
    need = np.array([least_shared(k, sketch, percent) for k in sizes])
    owner = np.repeat(np.arange(n), [len(k) for k in kept])
    _, place, times = np.unique(np.concatenate(kept), return_inverse=True, return_counts=True)
    common = times > 1
    column = np.cumsum(common) - 1
    grid = np.zeros((n, int(common.sum())), np.float32)
    at = common[place]
    grid[owner[at], column[place[at]]] = 1
    shared = grid @ grid.T
    side = np.array(sides)
    fits = np.triu(shared >= np.maximum(need[:, None], need[None, :]), 1)
    fits &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    fits &= (side[:, None] == 0) | (side[:, None] != side[None, :])
    a, b = np.nonzero(fits)
    # The estimate of the union's sketch: the most similar pairs join first and spare others.
    order = np.argsort(-shared[a, b] / np.maximum(need[a], need[b]), kind="stable")
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = top(i), top(j)
        if x != y:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                root[x] = y
    least: dict[int, int] = {}
    for i in range(n):
        least[top(i)] = min(nodes[i], least.get(top(i), nodes[i]))
    return [(least[top(i)], nodes[i]) for i in range(n) if least[top(i)] != nodes[i]]


def _full_sets(asked: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(num, full): the whole sets of the numbers in ``asked``.

    Only the texts of sets that are compared are read again.  They are found by a merge
    join at any size, so that plan and cost are alike for small and large inputs.
    """
    asked = asked.select("num").distinct().join(classes.select("num", F.col("name").alias("id"), "copy"), "num").hint("merge")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, known, size).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("num"), pa.array(sets, pa.binary())], names=["num", "full"])

    texts = docs.withColumn("copy", F.xxhash64("text")).join(asked, ["id", "copy"]).select("num", "text")
    return map_batches(texts, full, "num bigint, full binary")


def verified_links(units: DataFrame, docs: DataFrame, classes: DataFrame, size: int, sketch: int, percent: int) -> DataFrame:
    """(a, b): sets that the units' links join, each link confirmed on the full sets."""
    sets = _full_sets(units, docs, classes, size)
    rows = units.join(sets, "num").repartition("unit").sortWithinPartitions("unit", "num")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, sides, found = None, [], [], []

        def done() -> list[tuple[int, int]]:
            return _links_of_unit(nodes, sides, found, sketch, percent)

        for batch in batches:
            out = []
            for name, side, num, values in zip(*(batch.column(c).to_pylist() for c in ("unit", "side", "num", "full")), strict=True):
                if name != unit:
                    out += done()
                    unit, nodes, sides, found = name, [], [], []
                if not nodes or nodes[-1] != num:  # repeated rows give a set twice
                    nodes.append(num)
                    sides.append(side)
                    found.append(np.frombuffer(values, np.uint64))
            yield pairs(out)
        yield pairs(done())

    def pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return materialize(map_batches(rows.select("unit", "side", "num", "full"), work, "a bigint, b bigint"))


def components(links: DataFrame, names: DataFrame) -> DataFrame:
    """(num, label): the smallest (name, num) of all nodes that links reach; linked nodes only.

    Each round a node takes the smallest label of its neighbours and itself, then the label
    of the node that had given that label (so paths halve); every round is written to the
    shared folder, and the rounds end when no label changes.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = both.select(F.col("a").alias("num")).distinct().join(names, "num").select("num", F.struct("name", "num").alias("label"))
    labels = materialize(labels)
    while True:
        near = both.join(labels, both.b == labels.num).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels.num == near.a).select("num", "label", F.least("label", "near").alias("new"))
        ahead = labels.select(F.col("num").alias("via"), F.col("label").alias("ahead"))
        new = materialize(new.join(ahead, F.col("new.num") == F.col("via")).select("num", (F.least("new", "ahead") != F.col("label")).alias("moved"), F.least("new", "ahead").alias("label")))
        moved = new.where("moved").limit(1).count()
        labels = new.select("num", "label")
        if not moved:
            return labels


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST))


def resolved(rows: DataFrame, size: int, percent: int, sketch: int, block: int) -> DataFrame:
    """(id, text) to ``id, copy, n_shingles, component, group`` with one row per row.

    ``group`` is null without shingles; groups are told apart by it, as ids may repeat.
    """
    sets = sketches(rows, size, sketch)
    filled = sets.where("n_shingles > 0")
    classes = set_classes(filled)
    lists = materialize(inverted_lists(classes, sketch, percent))
    links = materialize(links_of_lists(lists, rows, classes, size, sketch, percent, block))
    names = classes.select("num", "node", "name")
    found = components(links, names.select("num", "name"))
    named = names.join(found, "num", "left").select("node", F.coalesce("label", F.struct("name", "num")).alias("label"))
    return filled.select("id", "copy", "n_shingles", "node").join(named, "node").select(
        "id", "copy", "n_shingles", F.col("label.name").alias("component"), F.col("label.num").alias("group")
    ).union(sets.where("n_shingles = 0").select("id", "copy", "n_shingles", F.col("id").alias("component"), F.lit(None).cast("bigint").alias("group")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, sketch: int = 64, block: int = 512) -> DataFrame:
    """Documents (doc_id, text) to ``doc_id, n_shingles, component_id, kept``.

    A document's set holds the distinct runs of ``size`` words of its whole text (A-Z in
    lower case; fewer words make one run).  Documents whose sets have an intersection of at
    least ``percent`` of their union are linked; a component is named by its smallest
    ``doc_id``, and that document is kept.  Equal sets count as one from the start, so copies
    are never compared.  Null, empty and blank texts have no shingles and are linked with
    nothing, not even each other.  A null id counts as the smallest; repeated rows are copies;
    other columns are ignored.
    """
    out = resolved(docs.select(_id().alias("id"), "text"), size, percent, sketch, block)
    no = F.lit(LOWEST)
    return out.select(
        F.nullif("id", no).alias("doc_id"), "n_shingles", F.nullif("component", no).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 75, sketch: int = 64, block: int = 512) -> DataFrame:
    """The same columns, one row per component of :func:`near_duplicates`: its smallest id.

    Of several rows with that id that belong to the component one stays.  Rows without
    shingles are linked with nothing and all stay.
    """
    found = resolved(docs.select(_id().alias("id"), "text"), size, percent, sketch, block)
    kept = found.where("group is not null").groupBy("group").agg(F.min(F.struct("id", "copy")).alias("k")).select("k.*").distinct()
    filled = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    id_name, copy_name = free_name(docs, "row_id"), free_name(docs, "row_copy")
    rows = docs.where(filled).withColumns({id_name: _id(), copy_name: F.xxhash64("text")})
    # The join leaves equal rows together: dropping repeated ones moves nothing again.
    kept = kept.select(F.col("id").alias(id_name), F.col("copy").alias(copy_name))
    rows = rows.join(kept, [id_name, copy_name], "left_semi").dropDuplicates([id_name, copy_name])
    return rows.select(*columns_of(docs)).union(docs.where(~filled))
