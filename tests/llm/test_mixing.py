"""The mix against a plain loop."""

import hashlib
import random

import pytest

from tallybook.llm import mixing


def plain(rows, share=1.5, most=2):
    """(doc_id, source, size) to sorted results, targets by resharing until none is above its cap."""
    rows = [(d, s, n or 0) for d, s, n in rows]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(n for _, t, n in rows if t == s) for s in names}
    left, open_, target = share * sum(size.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not above:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            target[s] = float(most * size[s])
        left -= sum(most * size[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    out = []
    for s in names:
        budget, place = int(target[s]), 0
        epochs = budget // size[s] if size[s] else 0
        mine = [(hashlib.md5(f"mix{'' if d is None else d}".encode()).hexdigest(), d is not None, d or 0, n, d) for d, t, n in rows if t == s]
        for *_, n, d in sorted(mine, key=lambda r: r[:4]):
            out.append((d, s, n, size[s], round(target[s], 6), epochs * n + max(0, min(n, budget - epochs * size[s] - place))))
            place += n
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "null", None, "z", ""]
    rows = [(i, rng.choice(sources[:2] if rng.random() < 0.5 else sources), rng.choice([0, 1, 7, 40, 900, None])) for i in range(300)]
    return [*rows, rows[0], (rows[1][0], rows[1][1], 5), (None, "a", 30), (999, "empty", 0), (1000, "long", 10**7)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_a_plain_loop(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, source string, size bigint, key string, target int")
    got = sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df).collect()), key=str)
    assert got == plain(rows)
    assert all(r[5] <= 2 * r[2] for r in got)


def test_small_tables(spark):
    df = spark.createDataFrame([(1, None, 10)], "doc_id bigint, source string, size bigint")
    assert [(r.target, r.taken) for r in mixing.mix(df).collect()] == [(15.0, 15)]
    assert mixing.mix(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "a", 0), (2, "b", None)], "doc_id bigint, source string, size bigint")
    assert [(r.target, r.taken) for r in mixing.mix(nothing).collect()] == [(0.0, 0), (0.0, 0)]


def test_own_weights_and_words(spark):
    df = spark.createDataFrame([(1, "a", "x  y\n z"), (2, "b", None), (3, "b", "q w"), (4, "a", "  k")], "doc_id bigint, source string, text string")
    sized = df.withColumn("size", mixing.n_words(df.text))
    assert [r["size"] for r in sized.orderBy("doc_id").collect()] == [3, 0, 2, 2]
    weights = spark.createDataFrame([("0a", 1), ("0b", 1)], "source_key string, weight bigint")
    got = {r.source: r.target for r in mixing.mix(sized, weights).collect()}
    assert got == {"a": 6.5, "b": 4.0}
