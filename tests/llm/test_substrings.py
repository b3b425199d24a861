"""Removed bytes against brute force over all windows."""

import hashlib
import random
from collections import Counter

import pytest

from tallybook.llm import queries
from tallybook.llm.substrings import remove_repeats


def brute(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    often = Counter(r[s : s + length] for _, r in raws for s in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = [False] * len(r)
        for s in range(len(r) - length + 1):
            if often[r[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgé "
    text = lambda k: "".join(rng.choices(letters, k=k))
    passages = [text(rng.randint(20, 160)) for _ in range(5)] + ["ab" * 70, "x" * 130, "é" * 40]
    rows = []
    for i in range(90):
        kind = rng.random()
        if kind < 0.15 and rows:
            t = list(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t)) if t else 0 : 0] = "!"
            t = "".join(t)
        else:
            t = "".join(text(rng.randint(0, 90)) + rng.choice(passages)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 3)))
        rows.append((i, t))
    return [*rows, rows[3], (3, rows[7][1]), (-1, None), (-2, ""), (None, passages[0] * 3)]


@pytest.mark.parametrize("seed, length, gram, steps", [(1, 60, 12, (16, 4, 1)), (2, 40, 40, (1,)), (3, 50, 5, (32, 4, 1)), (4, 64, 16, (8, 1))])
def test_same_as_brute_force(spark, seed, length, gram, steps):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id bigint, text string, key binary")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, length, gram, steps).collect()), key=str)
    assert got == brute(rows, length)
    assert any(0 < r[2] < r[1] for r in got)


def test_long_text_and_empty_table(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=300_000))
    df = spark.createDataFrame([(1, long), (2, "z" + long[1000:1400] + "z"), (3, "y" * 401)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(df).collect()}
    assert got == {1: (400, 1), 2: (400, 1), 3: (401, 1)}
    assert remove_repeats(df.limit(0)).count() == 0


def test_query_goes_by_bytes_whatever_the_number_of_words(spark, tmp_path):
    rng = random.Random(5)
    words = lambda n, k: " ".join("".join(rng.choices("abcdefgh", k=k)) for _ in range(n))
    passages = [words(60, 5), words(57, 6) + "z", words(57, 6) + "zz", words(20, 19) + "zz"]
    assert [len(p) for p in passages] == [359, 399, 400, 401]
    rows = []
    for passage in passages:
        for edge in "<>":  # no copy goes on beyond its passage
            rows.append((len(rows), words(40, 7) + edge + passage + edge + words(40, 7)))
    rows += [(8, None), (9, words(60, 5))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op10_remove_repeats"](spark, str(tmp_path)).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(rows, 400)]
    assert [r[2] for r in got] == [0, 0, 0, 0, 400, 400, 401, 401, 0, 0]
