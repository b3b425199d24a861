"""Held-out accuracy, shrinkage of sparse sites, and awkward rows."""

import random

from tallybook.llm import quality


def corpus(seed, n=600):
    rng = random.Random(seed)
    words = [f"wo{i}rd" for i in range(800)]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = rng.choices(words, k=rng.randint(20, 90))
        text = " ".join(w) if good else rng.choice([" ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join(w[:2] * 20)])
        rows.append((i, text, rng.choice(["s1", "s2", None]), rng.choice(["en", None])))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = corpus(1)
    rows += [(9000, None, "s1", "en"), (9001, "", "new", "xx"), (9001, "", "new", "xx"), (None, "a b c", None, None), (9002, "word " * 60_000, "s2", "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, source string, lang string, p double")
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (5, None), (77777, 0)], "doc_id bigint, quality int")
    out = quality.classify(docs, known)
    assert out.columns == [*docs.columns, "quality_score", "quality_kept"]
    got = {r.doc_id: r.quality_kept for r in out.collect()}
    assert out.count() == len(rows)
    unseen = [x for x in labels if x[0] % 3 == 0]
    assert sum(got[i] == bool(q) for i, q in unseen) >= 0.97 * len(unseen)
    assert not [i for i, q in labels if q and not got[i]]
    assert quality.classify(docs.limit(0), known).count() == 0
    assert quality.classify(docs, known.limit(0)).count() == len(rows)


def test_sparse_sites_are_drawn_to_the_global_rate(spark):
    rows = [("big", "big/a", 0.9)] * 400 + [("bad", "bad/a", 0.1)] * 400 + [("bad", "bad/b", 0.9)] + [("one", "one/a", 0.0)]
    rates = {(r.host, r.path): r.rate for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, p double"), 0.5).collect()}
    assert abs(rates["big", "big/a"] - 0.9) < 0.03 and abs(rates["bad", "bad/a"] - 0.1) < 0.03
    assert 0.1 < rates["one", "one/a"] < 0.5  # one document says little: near the global 0.5
    assert rates["bad", "bad/b"] < 0.7  # one page of a bad host
