"""Likelihoods against all state paths, counts against a plain loop, and the gain on unseen texts."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np

from tallybook.llm import hmm
from tallybook.llm.common import crc_of


def small_model():
    rng = np.random.default_rng(0)
    rows = lambda *shape: (m := rng.random(shape) + 0.1) / m.sum(-1, keepdims=True)
    return hmm.Model(rows(2), rows(2, 2), rows(2, 4), np.array([1, 2, 3]))


def paths(model, sequence):
    for states in itertools.product(range(2), repeat=len(sequence)):
        p = model.start[states[0]] * model.emit[states[0], sequence[0]]
        for a, b, s in zip(states, states[1:], sequence[1:], strict=False):
            p *= model.move[a, b] * model.emit[b, s]
        yield states, p


def test_likelihood_and_counts_are_exact():
    model, rng = small_model(), random.Random(2)
    sequences = [np.array([rng.randrange(4) for _ in range(n)], np.uint16) for n in (3, 1, 6, 6, 2)]
    want = [math.log(sum(p for _, p in paths(model, s))) for s in sequences]
    assert np.allclose(hmm.log_likelihoods(model, sequences), want)
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4))
    for s in sequences:
        total = sum(p for _, p in paths(model, s))
        for states, p in paths(model, s):
            start[states[0]] += p / total
            for a, b in zip(states, states[1:], strict=False):
                move[a, b] += p / total
            for a, x in zip(states, s, strict=True):
                emit[a, x] += p / total
    for got, expected in zip(hmm.expected_counts(model, sequences), (start, move, emit), strict=True):
        assert np.allclose(got, expected)


def corpus():
    rng = random.Random(4)
    tongues = [[f"{c}{i}" for i in range(60)] for c in "ab"]
    rows = [(i, " ".join(rng.choices(tongues[i % 2], k=rng.randint(0, 60)))) for i in range(160)]
    return [*rows, (200, None), (201, ""), (202, "A1 a1\na1\x0bÉ é"), (202, "A1 a1\na1\x0bÉ é"), (None, "b1"), (203, "a1 " * 30_000)]


def test_scores(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, n_tokens int")
    df = df.withColumn("held_out", crc_of(df.doc_id) % 5 == 1)
    tokens = {r: [*(r[1] or "").encode().lower().split(), b""] for r in rows}
    held = {r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows}
    counts = Counter(t for r in rows if not held[r] for t in tokens[r])
    n, v = sum(counts.values()), len(counts)
    base = {t: math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for ts in tokens.values() for t in ts}
    want = sorted((str(r[0]), held[r], len(tokens[r]), sum(t in counts for t in tokens[r]), n, round(sum(base[t] for t in tokens[r]), 6)) for r in rows)
    for frequent, symbols in ((1000, 1000), (20, 10), (3, 2)):
        got = hmm.score(df, states=3, symbols=symbols, frequent=frequent, rounds=6).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        if symbols == 1000:  # two tongues: the states tell them apart on texts that were held out
            unseen = [r for r in got if r.held_out and r.n_tokens > 20]
            assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) + 0.2 * sum(r.n_tokens for r in unseen)
    assert hmm.score(df.limit(0)).count() == 0


def test_probabilities_of_one_token_texts_add_up(spark):
    """All words and one unknown word, as the second token of any text, have probability 1 together."""
    rows = [(i, t) for i, t in enumerate(["a b a", "b c", "d a a b", "e"] * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "false held_out")
    asked = spark.createDataFrame([(100 + i, w) for i, w in enumerate("a b c d e zz".split())], "doc_id bigint, text string").selectExpr("*", "true held_out")
    got = {r.doc_id: r for r in hmm.score(df.union(asked), states=2, symbols=2, frequent=3, rounds=2).collect()}
    # P(word, end): summed over words it is P(second token is the end), below 1 and above 0.
    total = sum(10 ** got[100 + i].score for i in range(6))
    assert 0 < total < 1
    base = sum(10 ** got[100 + i].base_score for i in range(6))
    assert 0 < base < 1


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string").selectExpr("*", "true held_out")
    got = hmm.score(df).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
