"""A hidden Markov language model of word sequences, and the unigram score beside it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import by_value, map_batches, words_of, WordHashes
from tallybook.session import materialize

#: The token after the last word is the empty word, which no text has.
END = b""
#: Tokens whose states are kept at once, and bins of the histogram of counts per doubling.
AT_ONCE, BINS = 400_000, 16


@dataclass
class Counts:
    """Unigram counts of the training tokens: the table, its totals, and its frequent part."""

    table: DataFrame  # word bigint, n bigint; in the shared folder
    tokens: int
    distinct: int
    least: int  # words of at least this count are the frequent ones
    words: np.ndarray  # sorted hashes of the frequent words
    n: np.ndarray

    def scale(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def count_tokens(training: DataFrame, frequent: int) -> Counts:
    """Counts of all training tokens of (text); at most ``frequent`` words go to the driver.

    The least count of a frequent word is the border of a histogram bin, so all words of a
    count are treated alike, and no sort of the vocabulary is needed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(words_of(text))
                found[END] += 1
            if len(found) > WordHashes.most:
                yield out(found, known)
                found = Counter()
        yield out(found, known)

    def out(found: Counter, known: WordHashes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(known.of(list(found)).view(np.int64)), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    table = materialize(map_batches(training.select("text"), count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    totals = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("word").alias("distinct")).first()
    bins = sorted(table.groupBy(F.floor(F.log2("n") * BINS).alias("bin")).count().collect(), reverse=True)
    least, room = 2**62, frequent
    for bin_, size in bins:
        room -= size
        if room < 0:
            break
        least = int(np.ceil(2 ** (bin_ / BINS)))
    top = table.where(F.col("n") >= least).toPandas().sort_values("word")
    return Counts(table, totals["tokens"], totals["distinct"], least, top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64))


@dataclass
class Model:
    """States that emit the most frequent words, or one symbol for all the others."""

    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x symbols; the last symbol is "any other word"
    vocabulary: np.ndarray  # sorted hashes of the words that have a symbol


def first_model(counts: Counts, states: int, symbols: int, seed: int = 1) -> Model:
    """Sticky states around the unigram distribution, told apart by fixed random factors."""
    most = np.sort(np.lexsort((counts.words, -counts.n))[:symbols])
    chance = np.append(counts.n[most] + 0.5, 0.0) / counts.scale()
    chance[-1] = max(1 - chance.sum(), 1e-12)
    rng = np.random.default_rng(seed)
    emit = chance * np.exp(rng.normal(0, 0.5, (states, len(chance))))
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True), counts.words[most])


def _in_batches(symbols: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Numbers of the sequences, the longest first, in batches of bounded length."""
    order = np.argsort([-len(s) for s in symbols], kind="stable")
    at, size = 0, 0
    for i, j in enumerate(order):
        if size and size + len(symbols[j]) > AT_ONCE:
            yield order[at:i]
            at, size = i, 0
        size += len(symbols[j])
    if size:
        yield order[at:]


def _forward(model: Model, sequences: list[np.ndarray], keep: bool) -> tuple:
    """Scaled forward recursion over all sequences of a batch (longest first) at once."""
    lengths = np.array([len(s) for s in sequences])
    flat, starts = np.concatenate(sequences), np.cumsum(lengths) - lengths
    emit = np.ascontiguousarray(model.emit.T)
    # Sequences that still run at each step: a prefix, as they are sorted by length.
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    logs = np.zeros(len(sequences))
    if keep:
        states, scales = np.empty((len(flat), len(model.start))), np.empty(len(flat))
    state = None
    for step, n in enumerate(active):
        state = np.broadcast_to(model.start, (n, len(model.start))) if step == 0 else state[:n] @ model.move
        at = starts[:n] + step
        state = state * emit[flat[at]]
        scale = state.sum(1)
        state = state / scale[:, None]
        logs[:n] += np.log(scale)
        if keep:
            states[at], scales[at] = state, scale
    return (logs, flat, starts, active, emit, states, scales) if keep else (logs,)


def log_likelihoods(model: Model, symbols: list[np.ndarray]) -> np.ndarray:
    """ln of the exact likelihood of each sequence of symbol numbers."""
    out = np.zeros(len(symbols))
    for batch in _in_batches(symbols):
        out[batch] = _forward(model, [symbols[i] for i in batch], False)[0]
    return out


def expected_counts(model: Model, symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts, moves and emissions of some sequences."""
    k, m = model.emit.shape
    start, move, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
    for batch in _in_batches(symbols):
        _, flat, starts, active, emit, states, scales = _forward(model, [symbols[i] for i in batch], True)
        back = np.ones((active[-1], k))
        for step in range(len(active) - 1, -1, -1):
            n = active[step]
            if len(back) < n:  # the shorter ones end here
                back = np.vstack([back, np.ones((n - len(back), k))])
            at = starts[:n] + step
            if step:
                ahead = emit[flat[at]] * back / scales[at][:, None]
                move += states[at - 1].T @ ahead
            states[at] *= back
            if step:
                back = ahead @ model.move.T
        start += states[starts].sum(0)
        for i in range(k):
            emitted[i] += np.bincount(flat, states[:, i], m)
    return start, move * model.move, emitted


def _train_once(encoded: DataFrame, model: Model, base: np.ndarray, prior: float) -> Model:
    """One pass of Baum-Welch: counts added up in partitions, then across them."""
    shared = by_value(encoded, model)
    k, m = model.emit.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        sums = [np.zeros(k), np.zeros((k, k)), np.zeros((k, m))]
        for batch in batches:
            for total, new in zip(sums, expected_counts(model, _symbols(batch)), strict=True):
                total += new
        flat = np.concatenate([s.ravel() for s in sums])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["place", "n"])

    got = map_batches(encoded.select("symbols"), work, "place bigint, n double").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(k + k * k + k * m)
    flat[got["place"]] = got["n"]
    start, move, emit = flat[:k] + 1 / k, flat[k : k + k * k].reshape(k, k) + 1e-3, flat[k + k * k :].reshape(k, m) + prior * base
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True), model.vocabulary)


def _symbols(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint16) for s in batch.column("symbols").to_pylist()]


def encode(docs: DataFrame, counts: Counts, vocabulary: np.ndarray) -> DataFrame:
    """Documents (doc_id, text, held_out) to symbols, the score of frequent words, and rare words.

    Returns a table in the shared folder: ``row`` (a number of its own), ``doc_id``,
    ``held_out``, ``n_tokens``, ``symbols`` (two bytes a token), ``frequent_score`` and
    ``n_frequent`` (sum of log10(c + 0.5) over frequent words), ``outside_score`` (that sum
    over frequent words without a symbol), ``n_outside`` (tokens without a symbol) and
    ``rare`` (hashes of all other words).
    """
    shared = docs.sparkSession.sparkContext.broadcast((counts.words, np.log10(counts.n + 0.5), vocabulary))
    names = ["row", "doc_id", "held_out", "n_tokens", "symbols", "frequent_score", "n_frequent", "outside_score", "n_outside", "rare"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, scores, vocabulary = shared.value
        symbol = np.full(len(words) + 1, len(vocabulary))
        symbol[:-1][np.isin(words, vocabulary)] = np.arange(len(vocabulary))
        scores, symbol = np.append(scores, 0.0), symbol.astype(np.uint16)
        known, number = WordHashes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                tokens = known.of([*words_of(text), END]).view(np.int64)
                at = np.minimum(np.searchsorted(words, tokens), max(0, len(words) - 1))
                there = words[at] == tokens if len(words) else np.zeros(len(tokens), bool)
                at = np.where(there, at, len(words))
                symbols, own = symbol[at], scores[at]
                outside = symbols == len(vocabulary)
                rows.append((number, len(tokens), symbols.tobytes(), float(own.sum()), int(there.sum()),
                             float(own[outside].sum()), int(outside.sum()), tokens[~there]))
                number += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([arrays[0], batch.column("doc_id"), batch.column("held_out"), *arrays[1:]], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return materialize(map_batches(docs.select("doc_id", "held_out", "text"), work, (
        f"row bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, symbols binary, frequent_score double, "
        "n_frequent bigint, outside_score double, n_outside bigint, rare array<bigint>")))


def score(docs: DataFrame, states: int = 8, symbols: int = 16_384, frequent: int = 131_072, rounds: int = 3, prior: float = 10.0) -> DataFrame:
    """Fit on documents that are not held out and score all (doc_id, text, held_out).

    Tokens are the words of the whole text with A-Z in lower case and one end.  The base
    score is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens, from counts over
    all training tokens.  The ``frequent`` most frequent words are looked up in a broadcast
    table of that size; all others are joined with the whole table of counts.

    The model's states emit one of ``symbols`` words, or any other word, which is then drawn
    by the base distribution among those.  ``rounds`` passes of Baum-Welch over all training
    documents fit it; the likelihood is exact (forward recursion over the whole text).

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.  A null
    text counts as empty (one token); repeated rows count and score separately; without
    training rows N and V are 0 and all tokens unknown; other columns are ignored.
    """
    if not 0 < symbols < 1 << 16:
        raise ValueError("symbols must fit two bytes")
    counts = count_tokens(docs.where(~F.col("held_out")), frequent)
    model = first_model(counts, states, symbols)
    encoded = encode(docs, counts, model.vocabulary)
    chance = np.append(counts.n[np.isin(counts.words, model.vocabulary)] + 0.5, 0.0) / counts.scale()
    chance[-1] = max(1 - chance.sum(), 1e-12)
    for _ in range(rounds):
        model = _train_once(encoded.where(~F.col("held_out")), model, chance, prior)
    shared = by_value(docs, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            logs = log_likelihoods(model, _symbols(batch)) / np.log(10)
            yield batch.drop_columns(["symbols"]).append_column("states_score", pa.array(logs))

    kept = "row bigint, doc_id {}, held_out boolean, n_tokens bigint, frequent_score double, n_frequent bigint, outside_score double, n_outside bigint, states_score double"
    scored = map_batches(
        encoded.select("row", "doc_id", "held_out", "n_tokens", "symbols", "frequent_score", "n_frequent", "outside_score", "n_outside"),
        work, kept.format(docs.schema["doc_id"].dataType.simpleString()))
    rare = encoded.select("row", F.explode("rare").alias("word")).join(
        counts.table.where(F.col("n") < counts.least), "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_score"), F.count("n").alias("n_rare"))
    rows = scored.join(rare, "row", "left").withColumns({
        "rare_score": F.coalesce("rare_score", F.lit(0.0)), "n_rare": F.coalesce("n_rare", F.lit(0))})
    scale = float(np.log10(counts.scale()))
    # An outside word is drawn by its base probability among all words outside.
    outside = F.lit(scale + float(np.log10(chance[-1])))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.col("n_rare")).alias("n_known"),
        F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        (F.col("frequent_score") + F.col("rare_score") - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("states_score") + F.col("outside_score") + F.col("rare_score") - F.col("n_outside") * outside).alias("score"))
