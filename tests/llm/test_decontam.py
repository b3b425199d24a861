"""Leaks against brute force over all windows."""

import os
import random
import subprocess
import sys
import tracemalloc
from collections import Counter

import numpy as np
from pyspark import cloudpickle

from tallybook.llm import decontam


def plain(text):
    kept = "".join(c for c in (text or "") if not (33 <= ord(c) < 127 and not c.isalnum()))
    return kept.encode().lower().split()


def brute(docs, items, least=0.75):
    out = []
    for d, text in docs:
        w = plain(text)
        for item, it in items:
            v = plain(it)
            if not v:
                continue
            k = min(5, len(v))
            grams = [tuple(v[i : i + k]) for i in range(len(v) - k + 1)]
            own = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            best = None
            for s in range(len(own) - len(grams) + 1):
                a, b = Counter(own[s : s + len(grams)]), Counter(grams)
                alike = sum((a & b).values()) / sum((a | b).values())
                if alike >= least and (best is None or alike > best[0]):
                    best = (alike, s)
            if best:
                out.append((d, item, best[1], len(v), round(best[0], 9)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: rng.choices(words, k=n)
    items = [(i, " ".join(text(rng.choice([2, 5, 9, 20, 20, 45])))) for i in range(12)] + [(20, None), (21, "..."), (22, "aa aa aa aa aa aa aa aa"), (1, "w1 w2 w3 w4 w5 w6")]
    docs = []
    for d in range(80):
        w = text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            v = (rng.choice(items)[1] or "").split()
            if rng.random() < 0.4 and len(v) > 15:
                v[rng.randrange(len(v))] = "changed"
            v = [x.upper() + "," if rng.random() < 0.2 else x for x in v]
            w += v + text(rng.randint(0, 30))
        docs.append((d, " ".join(w)))
    return [*docs, docs[2], (None, docs[3][1]), (-1, None), (-2, ""), (-3, "aa " * 400)], items


def test_same_as_brute_force(spark):
    docs, items = corpus(2)
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, similarity string")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    got = lambda **a: sorted(((r.doc_id, r.item_id, r.first_word, r.n_words, round(r.similarity, 9)) for r in decontam.find_leaks(df, bench, **a).collect()), key=str)
    # Two items share a number: the better one of each block counts.
    want = brute(docs, [x for x in items if x != (1, items[1][1]) and x != items[-1]])
    assert [x for x in got() if x[1] != 1] == [x for x in want if x[1] != 1] and want
    assert [x for x in got(items_at_once=3) if x[1] != 1] == [x for x in want if x[1] != 1]
    leaky = {x[0] for x in got()}
    assert sorted(str(r.doc_id) for r in decontam.without_leaks(df, bench).collect()) == sorted(str(d) for d, _ in docs if d not in leaky)
    assert decontam.find_leaks(df.limit(0), bench).count() == 0
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0


def test_repeated_shingles_same_as_brute_force():
    rng = random.Random(5)
    words = lambda n: rng.sample([f"v{i}" for i in range(100_000)], n)
    items, docs = [], []
    for i, (shared, run) in enumerate([(154, 24), (226, 32), (92, 14), (34, 4)] * 6):
        body, tail, zeros = words(shared), words(run), ["0"] * run
        items.append((i, " ".join(body + (zeros if i % 2 else tail))))
        docs.append((i, " ".join([*words(7), *body, *(tail if i % 2 else zeros), *words(9)])))
    docs += [(100, "0 1 " * 500), (101, "0 " * 500)]
    items += [(100, "0 1 " * 20), (101, "0 0 0 0 0 0 0 0 0 0 0 0 1")]
    benchmark = decontam.build(items, 5)
    got = sorted(((d, item, at, n, round(alike, 9)) for d, t in docs
                  for item, at, n, alike in decontam.hits(t, benchmark, decontam.WordHashes(), 0.75, 40)), key=str)
    want = brute(docs, items)
    assert got == want and len(want) >= 8


def test_long_text(spark):
    items = [(1, " ".join(f"q{i}" for i in range(30)))]
    rng = random.Random(1)
    text = " ".join(rng.choices(["a", "b", "c"], k=150_000)) + " " + items[0][1] + " tail"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = decontam.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert [(r.item_id, r.first_word, r.similarity) for r in got] == [(1, 150_000, 1.0)]


def test_a_text_full_of_items_takes_little_memory():
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 20, 30])))) for i in range(1_200)]
    benchmark = decontam.build(items, 5)
    text = " x ".join(t for _, t in items)
    tracemalloc.start()
    found = decontam.hits(text, benchmark, decontam.WordHashes(), 0.75, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(f[0], f[3]) for f in found] == [(i, 1.0) for i, _ in items] and peak < 300e6


def test_pieces_change_nothing(monkeypatch):
    docs, items = corpus(4)
    benchmark = decontam.build([i for i in items if i[0] != 1], 5)
    text = " ".join(t or "" for _, t in docs)
    whole = decontam.hits(text, benchmark, decontam.WordHashes(), 0.75, 40)
    monkeypatch.setattr(decontam, "SHINGLES_AT_ONCE", 7)
    monkeypatch.setattr(decontam, "PAIRS_AT_ONCE", 5)
    assert decontam.hits(text, benchmark, decontam.WordHashes(), 0.75, 40) == whole and whole


def test_models_load_without_the_package(tmp_path):
    from tallybook.llm import hmm, quality

    values = [decontam.build([(1, "a b c d e f g")], 5), quality.train(np.random.default_rng(1).random((20, quality.FEATURES)), np.arange(20) % 2.0),
              hmm.Model(np.ones(1), np.ones((1, 1)), np.ones((1, 2)), np.arange(1))]
    (tmp_path / "v").write_bytes(cloudpickle.dumps(values))
    code = "import pickle; print(len(pickle.load(open('v', 'rb')))); import sys; assert not any(m.startswith('tallybook') for m in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.strip() == "3"
