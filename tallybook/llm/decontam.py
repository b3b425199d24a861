"""Benchmark decontamination: SimHash windows of an item's size, exact similarity after."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import WordHashes, by_value, map_batches, mixed, shingles

BITS = 128
#: Pairs of windows and items that are looked at together, and shingles that get votes together.
PAIRS_AT_ONCE, SHINGLES_AT_ONCE = 1 << 20, 1 << 14
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_POPCOUNT = np.array([i.bit_count() for i in range(1 << 16)], np.uint8)


def plain_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case and without ASCII punctuation; nothing left is no word."""
    return text.encode().translate(_LOWER, _PUNCTUATION).split() if text else []


def signs(hashes: np.ndarray) -> np.ndarray:
    """The signed bits (1 or -1) of each shingle's hash."""
    streams = np.stack([mixed(hashes + np.uint64(s)) for s in range(BITS // 64)], 1)
    return np.unpackbits(streams.view(np.uint8).reshape(len(hashes), -1), axis=1).astype(np.int32) * 2 - 1


def prints(votes: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 16-bit blocks."""
    return np.packbits(votes > 0, axis=1).view(np.uint16)


@dataclass
class SizeIndex:
    """The items of one size (number of shingles) and the tables of their blocks."""

    items: list[int] = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)
    prints: np.ndarray | None = None
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # a block's keys, and each item's
    repeated: set[int] = field(default_factory=set)  # items in which a shingle comes twice
    holders: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))

    def close(self) -> None:
        for i, found in enumerate(self.shingles):
            single = np.unique(found)
            if len(single) < len(found):
                self.repeated.add(i)
            for shingle in single.tolist():
                self.holders[shingle].append(i)
        self.prints = np.concatenate([prints(signs(s).sum(0)[None, :]) for s in self.shingles])
        for block in range(BITS // 16):
            keys, place = np.unique(self.prints[:, block], return_inverse=True)
            self.tables.append((keys, place))

    def within(self, asked: np.ndarray, radius: int) -> list[tuple[int, int]]:
        """(window, item) pairs with fingerprints at most ``radius`` bits apart, all of them.

        Two such fingerprints differ in at most radius / blocks bits in some block, so the
        keys of each block's table that are that near give all candidates.  So wide a radius
        admits many, so windows go in pieces: a text full of items takes no more memory.
        """
        near, out = radius // (BITS // 16), []
        step = max(1, PAIRS_AT_ONCE // len(self.items))
        for low in range(0, len(asked), step):
            part = asked[low : low + step]
            found = np.zeros((len(part), len(self.items)), bool)
            for block, (keys, place) in enumerate(self.tables):
                found |= (_POPCOUNT[part[:, block][:, None] ^ keys[None, :]] <= near)[:, place]
            w, i = np.nonzero(found)
            close = _POPCOUNT[part[w] ^ self.prints[i]].sum(1, dtype=np.int64) <= radius
            out += zip((w[close] + low).tolist(), i[close].tolist(), strict=True)
        return out

    def sharing(self, window: np.ndarray, least: float) -> set[int]:
        """The items that may be ``least`` similar to a window: none that is gets lost.

        Such items lack shingles of a bounded weight, so they hold one of any shingles that
        weigh more; the rarest are asked.
        """
        spare, found = len(window) * (1 - least) / (1 + least), set()
        weights = Counter(window.tolist())
        for shingle in sorted(weights, key=lambda s: len(self.holders.get(s, ()))):
            found.update(self.holders.get(shingle, ()))
            spare -= weights[shingle]
            if spare < -1e-9:
                break
        return found


def next_repeat(own: np.ndarray) -> np.ndarray:
    """For each place, the first place at which some shingle from there on comes again."""
    order = np.argsort(own, kind="stable")
    again = np.full(len(own), len(own) + 1)
    same = np.flatnonzero(own[order[1:]] == own[order[:-1]])
    again[order[same]] = order[same + 1]
    return np.minimum.accumulate(again[::-1])[::-1]


@dataclass
class Benchmark:
    """Items by shingle length (fewer words than ``size`` make one shingle) and number of shingles."""

    sizes: dict[int, dict[int, SizeIndex]]
    known: dict[int, np.ndarray]  # sorted shingle hashes by shingle length


def build(items: list[tuple[int, str | None]], size: int) -> Benchmark:
    words, sizes, known = WordHashes(), defaultdict(lambda: defaultdict(SizeIndex)), defaultdict(list)
    for item, text in items:
        hashes = words.of(plain_words(text))
        if len(hashes):
            found = shingles(hashes, size)
            index = sizes[min(size, len(hashes))][len(found)]
            index.items.append(item)
            index.shingles.append(found)
            known[min(size, len(hashes))].append(found)
    for by_count in sizes.values():
        for index in by_count.values():
            index.close()
    return Benchmark({k: dict(v) for k, v in sizes.items()}, {k: np.unique(np.concatenate(v)) for k, v in known.items()})


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger weights; a shingle weighs its count."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both)


def hits(text: str | None, benchmark: Benchmark, words: WordHashes, least: float, radius: int) -> list[tuple[int, int, int, float]]:
    """(item, first word, number of words, similarity) of each item's most similar window.

    Windows that have too few shingles of the benchmark to reach ``least`` can't match and
    get no fingerprint; all others do, at every place and for every size of an item.  A
    repeated shingle moves many bits at once, so windows and items that have one are also
    compared by their shingles, windows of the same shingles once.
    """
    hashes = words.of(plain_words(text))
    best: dict[int, tuple[float, int, int]] = {}
    for length, by_count in benchmark.sizes.items():
        if len(hashes) < length:
            continue
        own = shingles(hashes, length)
        at = np.minimum(np.searchsorted(benchmark.known[length], own), len(benchmark.known[length]) - 1)
        there = benchmark.known[length][at] == own
        if not there.any():
            continue
        total = np.concatenate([[0], np.cumsum(there)])
        # Only stretches around known shingles need votes; far apart ones are separate.
        reach = max(by_count)
        places = np.flatnonzero(there)
        for stretch in np.split(places, np.flatnonzero(np.diff(places) > 2 * reach) + 1):
            begin, end = max(0, stretch[0] - reach), min(len(own), stretch[-1] + reach + 1)
            for low in range(begin, end, SHINGLES_AT_ONCE):  # windows that start in a piece; long stretches have several
                past = min(low + SHINGLES_AT_ONCE, end)
                high = min(past + reach, end)
                votes = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(own[low:high]), 0, dtype=np.int32)])
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(own[low:high]))])
                again = next_repeat(own[low:high])
                for count, index in by_count.items():
                    first = np.arange(low, min(past, high - count + 1))
                    first = first[total[first + count] - total[first] >= least * count] if len(first) else first
                    if not len(first):
                        continue
                    windows = prints(votes[first - low + count] - votes[first - low])
                    pairs = set(index.within(windows, radius))
                    twice = again[first - low] < first - low + count
                    for w in np.unique(sums[first - low + count] - sums[first - low], return_index=True)[1].tolist():
                        if twice[w] or index.repeated:
                            start = int(first[w])
                            near = index.sharing(own[start : start + count], least)
                            pairs.update((w, i) for i in near if twice[w] or i in index.repeated)
                    for w, i in sorted(pairs):
                        start = int(first[w])
                        alike = similarity(own[start : start + count], index.shingles[i])
                        item = index.items[i]
                        if alike >= least and (item not in best or (alike, -start) > (best[item][0], -best[item][1])):
                            best[item] = (alike, start, count + length - 1)
    return sorted((item, start, n, alike) for item, (alike, start, n) in best.items())


def _blocks(benchmark: DataFrame, items_at_once: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about ``items_at_once``: the driver and tasks hold one at a time."""
    n = benchmark.count()
    pieces = -(-n // items_at_once)
    for piece in range(pieces):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)) == piece)
        yield sorted(((r["item_id"], r["text"]) for r in rows.select("item_id", "text").distinct().collect()), key=str)


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.75, radius: int = 40, items_at_once: int = 20_000) -> DataFrame:
    """Documents (doc_id, text) to one row per benchmark item (item_id, text) found in them.

    Returns ``doc_id, item_id, first_word, n_words, similarity`` of the most similar window
    (ties: the first).  Words are plain (see :func:`plain_words`), shingles have ``size``
    words; a window has as many shingles as the item.  Fingerprints have 128 bits; at the
    threshold two differ in 22 bits on average with a deviation of 4.3, so the radius of 40
    is four deviations away.  That holds for shingles that differ; where one is repeated, in the
    window or the item, shared shingles give the candidates instead.  Items without words match nothing, null and empty texts have
    no windows, repeated rows give repeated results, other columns are ignored.  The items
    are the query set: they run against all documents in blocks of ``items_at_once``.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, first_word bigint, n_words bigint, similarity double"
    out = None
    for block in _blocks(benchmark, items_at_once):
        shared = by_value(docs, build(block, size))
        kind = pa.string() if item_type == "string" else pa.int32() if item_type == "int" else pa.int64()

        def work(batches: Iterator[pa.RecordBatch], shared=shared, kind=kind) -> Iterator[pa.RecordBatch]:
            words, known = WordHashes(), shared()
            for batch in batches:
                rows = [(place, *h) for place, t in enumerate(batch.column("text").to_pylist()) for h in hits(t, known, words, least, radius)]
                ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((kind, pa.int64(), pa.int64(), pa.float64()), 1)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        found = map_batches(docs.select("doc_id", "text"), work, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.75, radius: int = 40, items_at_once: int = 20_000) -> DataFrame:
    """The documents that hold no benchmark item, with the same columns and no shuffle."""
    for block in _blocks(benchmark, items_at_once):
        shared = by_value(docs, build(block, size))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, known = WordHashes(), shared()
            for batch in batches:
                clean = [not hits(t, known, words, least, radius) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = map_batches(docs, work, docs.schema)
    return docs
