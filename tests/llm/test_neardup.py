"""Components against brute force over all pairs."""

import random

import pytest

from tallybook.llm.neardup import around_centers, groups_of_lists, inverted_lists, near_duplicates, set_classes, sketches


def brute(rows):
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[top(i)] = top(j)
    low = lambda d: (d is not None, d or 0)
    best = {}
    for i, (d, _) in enumerate(sets):
        r = top(i)
        if r not in best or low(d) < low(best[r]):
            best[r] = d
    return sorted(((d, len(s), best[top(i)], d == best[top(i)]) for i, (d, s) in enumerate(sets)), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    text = lambda k: rng.choices(words, k=k)
    base, passage = text(160), text(60)
    rows = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35:  # near copies around the threshold
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind < 0.6:  # a common passage in texts of all lengths
            w = text(rng.randint(0, 60)) + passage + text(rng.randint(0, 40))
        elif kind < 0.7:
            w = text(rng.randint(0, 6))
        elif kind < 0.8 and rows:
            w = (rng.choice(rows)[1] or "x").split()
            w = w[: len(w) - rng.randint(0, 4)]
        else:
            w = text(rng.randint(5, 400))
        rows.append((rng.randrange(10**6), " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 16)])
def test_same_as_brute_force(spark, seed, block):
    rows = corpus(seed)
    rows += [rows[0], rows[0], (None, rows[3][1]), (-1, None), (-2, ""), (-3, " \n"), (-4, "one two"), (-5, "One  TWO"), (-6, rows[5][1].upper())]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, node string")
    got = sorted((tuple(r) for r in near_duplicates(df, block=block).collect()), key=str)
    assert got == brute(rows)
    assert any(r[0] != r[2] for r in got)


def template(n, seed=5):
    """Near copies of two texts, a third of them far from both, all with one passage."""
    rng = random.Random(seed)
    text = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    passage, bases, rows = text(60), (text(200), text(200)), []
    for i in range(n):
        w = list(bases[i % 2]) if i % 3 else text(rng.randint(5, 200))
        for _ in range(rng.choice((1, 2, 4, 7, 11))):
            w[rng.randrange(len(w))] = rng.choice(("x", "y", "z")) + str(rng.randrange(999))
        rows.append((i, " ".join(passage + w)))
    return rows


def test_large_groups_meet_their_centers(spark):
    rows = template(300)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = sorted((tuple(r) for r in near_duplicates(df, block=12).collect()), key=str)
    assert got == brute(rows)


def test_near_copies_of_one_text_cost_their_number(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(5)
    classes = set_classes(sketches(df, 5, 64).where("n_shingles > 0"))
    groups = groups_of_lists(inverted_lists(classes, 64, 75))
    links, units = around_centers(groups, df, classes, 5, 75, 16)
    assert groups.agg({"n": "max"}).first()[0] >= 500
    assert links.count() >= 500 and units.count() <= links.count() / 4
    assert {r["component_id"] for r in near_duplicates(df.withColumnRenamed("id", "doc_id"), block=16).collect()} == {0}


def test_long_text_and_empty_table(spark):
    long = " ".join(f"a{i % 50_000}" for i in range(120_000))
    df = spark.createDataFrame([(2, long), (1, long + " z"), (3, "q")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == [(1, 50_001, 1, True), (2, 50_000, 1, False), (3, 1, 3, True)]
    assert near_duplicates(df.limit(0)).count() == 0
