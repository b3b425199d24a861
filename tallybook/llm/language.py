"""Language identification: unigram pieces of a fixed vocabulary, summed over segmentations."""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import map_batches
from tallybook.session import materialize

_LETTERS = re.compile(r"[^\W\d_]+")
#: Words remembered by a task, the longest of them in bytes, and words looked up at once.
REMEMBERED, SHORT, AT_ONCE = 400_000, 64, 50_000
#: Words summed at once, places of words in one table, and places between two rescalings.
WORDS_AT_ONCE, PLACES_AT_ONCE, RESCALE = 4_096, 500_000, 16


def read_pieces(path: str, longest: int = 8) -> list[bytes]:
    """The byte pieces of a public vocabulary (base64 and rank a line), up to ``longest`` bytes.

    All single bytes are among them, so every word has a segmentation.
    """
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    pieces |= {bytes([b]) for b in range(256)}
    return sorted(p for p in pieces if len(p) <= longest)


class Segmenter:
    """Sums over all segmentations of many words at once, longest first, without padding."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.count = len(pieces)
        self.tables = []
        for size in range(1, max(map(len, pieces)) + 1):
            found = sorted((int.from_bytes(p), i) for i, p in enumerate(pieces) if len(p) == size)
            self.tables.append((np.array([k for k, _ in found], np.uint64), np.array([i for _, i in found], np.int32)))

    def _places(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: int, last: int) -> np.ndarray:
        """Numbers of the pieces (by size, end place, word) that end after byte first+1 .. last.

        ``self.count`` is the number of no piece.
        """
        ends = np.arange(first + 1, last + 1)[:, None]
        at = np.minimum(starts[None, :] + ends - 1, len(flat) - 1)
        out = np.full((len(self.tables), *at.shape), self.count, np.int32)
        code, inside = np.zeros(at.shape, np.uint64), ends <= lengths[None, :]
        for size, (keys, numbers) in enumerate(self.tables, 1):
            code |= flat[np.maximum(at - size + 1, 0)].astype(np.uint64) << np.uint64(8 * (size - 1))
            if len(keys):
                found = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                out[size - 1] = np.where((keys[found] == code) & inside & (ends >= size), numbers[found], self.count)
        return out

    def _spans(self, lengths: np.ndarray) -> list[tuple[int, int, int]]:
        """Ranges of places with the number of words (longest first) that reach into them.

        A range has at most ``PLACES_AT_ONCE`` places of words, in whole multiples of ``RESCALE``.
        """
        out, first = [], 0
        while len(lengths) and first < lengths[0]:
            alive = int(np.searchsorted(-lengths, -first, "left"))
            last = min(int(lengths[0]), first + max(1, PLACES_AT_ONCE // (alive * RESCALE)) * RESCALE)
            out.append((first, last, alive))
            first = last
        return out

    @staticmethod
    def _laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths

    def log_likelihoods(self, words: list[bytes], probabilities: np.ndarray) -> np.ndarray:
        """ln of the sum over all segmentations, by word (row) and language (column).

        The forward sums are rescaled every few places, so words of any length keep their value;
        only the sums of the last places are held.
        """
        out = np.zeros((len(words), len(probabilities)))
        order = np.array(sorted(range(len(words)), key=lambda i: -len(words[i])), np.int64)
        table = np.vstack([probabilities.T, np.zeros(len(probabilities))])
        sizes = len(self.tables)
        for mine in (order[i : i + WORDS_AT_ONCE] for i in range(0, len(order), WORDS_AT_ONCE)):
            flat, starts, lengths = self._laid_out([words[i] for i in mine])
            longer = np.searchsorted(-lengths, -np.arange(lengths[0] + 1)).tolist()  # words with more than so many bytes
            # Row RESCALE holds the place before the block, the rows after it earlier ones.
            sums = np.zeros((RESCALE + sizes, len(mine), len(probabilities)))
            sums[RESCALE], scale = 1, np.zeros((len(mine), len(probabilities)))
            for first, last, alive in self._spans(lengths):
                numbers = self._places(flat, starts[:alive], lengths[:alive], first, last)
                for place in range(first, last, RESCALE):
                    alive, steps = longer[place], min(RESCALE, last - place)
                    for step in range(1, steps + 1):
                        row = RESCALE - step
                        chances = table[numbers[:, place - first + step - 1, :alive]]
                        np.einsum("swl,swl->wl", sums[row + 1 : row + 1 + sizes, :alive], chances, out=sums[row, :alive])
                        done = slice(longer[place + step], longer[place + step - 1])
                        if done.start < done.stop:
                            out[mine[done]] = scale[done] + np.log(sums[row, done])
                    row, alive = RESCALE - steps, longer[place + steps]
                    if alive:
                        factor = sums[row, :alive].copy()
                        sums[RESCALE:, :alive] = sums[row : row + sizes, :alive] / factor
                        scale[:alive] += np.log(factor)
        return out

    def expected(self, words: list[bytes], weights: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
        """Expected counts of pieces in words (forward-backward), weighted.

        Forward sums are kept with the logarithm of their scale (16 bytes a place).
        """
        table, counts = np.append(probabilities, 0.0), np.zeros(self.count + 1)
        order = np.array(sorted(range(len(words)), key=lambda i: -len(words[i])), np.int64)
        taken = 0
        while taken < len(order):
            mine = order[taken : taken + min(WORDS_AT_ONCE, max(1, PLACES_AT_ONCE // max(1, len(words[order[taken]]))))]
            taken += len(mine)
            counts += self._expected_of([words[i] for i in mine], np.asarray(weights)[mine], table)
        return counts[:-1]

    def _expected_of(self, words: list[bytes], weights: np.ndarray, table: np.ndarray) -> np.ndarray:
        flat, starts, lengths = self._laid_out(words)
        sizes, everyone, counts = len(self.tables), np.arange(len(words)), np.zeros(self.count + 1)
        if not len(flat):
            return counts
        spans, numbers = self._spans(lengths), None
        forward, scales = np.zeros((int(lengths[0]) + 1, len(words))), np.zeros((int(lengths[0]) + 1, len(words)))
        forward[0], scale = 1, np.zeros(len(words))
        window = np.zeros((sizes, len(words)))
        window[0] = 1
        for first, last, _ in spans:
            numbers = self._places(flat, starts, lengths, first, last)
            for end in range(first + 1, last + 1):
                total = (window * table[numbers[:, end - first - 1]]).sum(0)
                forward[end], scales[end] = total, scale
                window = np.concatenate([total[None], window[:-1]])
                if end % RESCALE == 0:
                    factor = np.where(total > 0, total, 1.0)
                    window /= factor
                    scale = scale + np.log(factor)
        whole = forward[lengths, everyone]
        possible = whole > 0
        whole = np.where(possible, np.log(np.where(possible, whole, 1.0)) + scales[lengths, everyone], 0.0)
        weights, scale = np.where(possible, weights, 0.0), np.zeros(len(words))
        window = np.zeros((sizes + 1, len(words)))
        for first, last, _ in reversed(spans):
            if len(spans) > 1:
                numbers = self._places(flat, starts, lengths, first, last)
            for end in range(last, first, -1):
                here = window[0] + (lengths == end)
                found = numbers[:, end - first - 1]
                before = np.maximum(end - 1 - np.arange(sizes), 0)
                onward = table[found] * here
                share = forward[before] * onward
                if end > RESCALE and (end - 1) % RESCALE < sizes:  # the places before lie on two scales
                    share *= np.exp(scales[before] - scales[end - 1])
                share *= weights * np.exp(scales[end - 1] + scale - whole)
                some = np.flatnonzero(share)
                if len(some) < 2_000:
                    np.add.at(counts, found.ravel()[some], share.ravel()[some])
                else:
                    counts += np.bincount(found.ravel()[some], share.ravel()[some], self.count + 1)
                window = np.concatenate([window[1:], np.zeros((1, len(words)))])
                window[:-1] += onward
                if end % RESCALE == 0:
                    factor = window.max(0)
                    factor = np.where(factor > 0, factor, 1.0)
                    window /= factor
                    scale = scale + np.log(factor)
        return counts


def letter_words(text: str | None) -> list[bytes]:
    """The runs of letters of a text in lower case, each after a blank, as UTF-8."""
    return [b" " + w.encode() for w in _LETTERS.findall(text.lower())] if text else []


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(labelled: DataFrame, path: str, per_language: int = 2000, rounds: int = 3, longest: int = 8) -> tuple[list[str], np.ndarray]:
    """Languages (by code point) and probabilities of pieces, learned from (doc_id, text, lang).

    Fitted on a bounded sample: about ``per_language`` different texts of each language, chosen
    by their hash (one row a language is broadcast); copies of a text count once.  Expected counts
    of pieces over all segmentations are added up across partitions in each of ``rounds`` passes,
    words of any length among them.  Rows without text or language teach nothing.
    """
    spark = labelled.sparkSession
    pieces = read_pieces(path, longest)
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    share = sizes.select("lang", F.least(F.lit(1_000_000), F.ceil(1_000_000 * per_language / F.greatest("n", F.lit(1)))).alias("share"))
    rows = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.col("share"))
    rows = rows.select("lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update((lang, w) for w in letter_words(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "word", "n"])

    words = materialize(map_batches(rows, count, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    model = np.full((len(languages), len(pieces)), 1 / len(pieces))
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((pieces, languages, model))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, languages, model = shared.value
            segmenter, sums = Segmenter(pieces), np.zeros((len(languages), len(pieces)))
            for batch in batches:
                langs = np.array(batch.column("lang").to_pylist())
                words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for i, lang in enumerate(languages):
                    mine = np.flatnonzero(langs == lang)
                    sums[i] += segmenter.expected([words[j] for j in mine], n[mine].astype(float), model[i])
            i, j = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums[i, j])], names=["language", "piece", "n"])

        got = map_batches(words, expect, "language bigint, piece bigint, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).toPandas()
        model = np.full((len(languages), len(pieces)), 0.01)
        model[got["language"], got["piece"]] += got["n"]
        model /= model.sum(1, keepdims=True)
    return languages, model


def predict(docs: DataFrame, path: str, languages: list[str], model: np.ndarray, longest: int = 8) -> DataFrame:
    """Documents (doc_id, text) to ``doc_id, lang_pred, score``.

    A text's probability in a language is the product over its words of the sum over all
    segmentations; the language with the highest wins (ties: the first by code point), its
    score is its share of the sum over languages.  Null texts, texts without a letter and
    an empty model give ``und`` with score 0.  Whole texts are read; other columns ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((read_pieces(path, longest), languages, model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, languages, model = shared.value
        segmenter, known = Segmenter(pieces), {}
        values = np.zeros((REMEMBERED + AT_ONCE, len(languages)))

        def learn(words: list[bytes]) -> None:
            new = list({w for w in words if len(w) <= SHORT and w not in known})
            if len(known) + len(new) > len(values):
                known.clear()
                learn(words)
                return
            if not new:
                return
            values[len(known) : len(known) + len(new)] = segmenter.log_likelihoods(new, model)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))

        def score(words: list[bytes]) -> np.ndarray:
            total = np.zeros(len(languages))
            for i in range(0, len(words), AT_ONCE):
                part = [w for w in words[i : i + AT_ONCE] if len(w) <= SHORT]
                learn(part)
                total += values[np.fromiter(map(known.__getitem__, part), np.int64, len(part))].sum(0)
            # Longer runs are seldom seen again: they are summed, not remembered.
            runs = Counter(w for w in words if len(w) > SHORT)
            if runs:
                total += np.fromiter(runs.values(), float) @ segmenter.log_likelihoods(list(runs), model)
            return total

        for batch in batches:
            names, scores = [], []
            texts = batch.column("text").to_pylist()
            for i in range(0, len(texts), 64):
                lists = [letter_words(t) if languages and t and has_letter(t) else [] for t in texts[i : i + 64]]
                if sum(map(len, lists)) <= AT_ONCE:
                    learn([w for words in lists for w in words])
                for words in lists:
                    if not words:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    total = score(words)
                    best = int(total.argmax())
                    names.append(languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {id_type}, lang_pred string, score double")
