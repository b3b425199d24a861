"""Every stage against a plain version on a small table with awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm import decontam, neardup, pii, quality
from test_neardup import brute, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(8)
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", None]), len(t)) for i, (_, t) in enumerate(corpus(5, 120))]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in t.split()) or "A!!", "en", "s1", 5) for i, (_, t) in enumerate(corpus(6, 60))]
    item = " ".join(f"q{i}" for i in range(20))
    rows += [*bad, (500, None, None, None, None), (501, "", "en", "s2", 0), (502, f"w1 w2 {item} w3", "en", "s1", 1),
             (503, "mail a@b.co today w7 w8", "en", "s1", 1), (503, "mail a@b.co today w7 w8", "en", "s1", 1), (503, "other text with that id w9", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{root}/documents.parquet")
    labels = [(r[0], int(r[0] < 1000), 0) for r in rows if r[0] % 3 or r[0] > 900] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.quality_stage(spark, docs, folder)
    assert good.columns == docs.columns
    left = rows_of(good)
    assert not [r for r in left if r[0] >= 1000 and len(r[1].split()) > 10]
    assert len([r for r in left if r[0] < 400]) == 120

    single = corpus_pipeline.near_duplicate_stage(spark, good, folder)
    assert single.columns == docs.columns
    # brute force on distinct ids: rows of one id are numbered apart
    numbered = [(n, r[1]) for n, r in enumerate(left)]
    by_text = {n: r for n, r in enumerate(left)}
    groups = {}
    for n, size, root, _ in brute(numbered):
        groups.setdefault(root if size else ("empty", n), []).append(by_text[n])
    got = rows_of(single)
    assert len(got) == len(groups)
    assert sorted(str(r[0]) for r in got) == sorted(str(min(g, key=lambda r: r[0])[0]) for g in groups.values())

    clean = corpus_pipeline.decontaminate_stage(spark, single, folder)
    assert rows_of(clean) == [r for r in got if r[0] != 502]

    safe = corpus_pipeline.pii_stage(spark, clean, folder)
    texts = {r[0]: r for r in rows_of(safe)}
    assert {r[1] for r in rows_of(safe) if r[0] == 503} == {"mail [EMAIL] today w7 w8", "other text with that id w9"}
    assert texts[500][1] is None and all(r[4] == len(r[1]) for r in texts.values() if r[1] is not None)

    mixed = corpus_pipeline.mixing_stage(spark, safe, folder)
    size = lambda t: len((t or "").encode().split())
    taken, total, texts = {}, 0, {}
    for r in rows_of(safe):
        texts.setdefault(r[0], []).append(r[1] or "")
    for r in rows_of(mixed):
        taken.setdefault(r[3], [0, r[6]])[0] += r[7]
        assert r[7] == size(r[1]) > 0 and r[5] in (1, 2) and r[4] == len(r[1])
        assert any(r[1] == whole or whole.startswith(r[1]) and size(r[1]) < size(whole) for whole in texts[r[0]])
    total = sum(size(r[1]) for r in rows_of(safe))
    assert abs(sum(t for _, t in taken.values()) - 1.5 * total) < 1
    assert all(got == int(target) for got, target in taken.values())


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 20
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as size", "2 as rate", "'x' as node", "3 as block", "4 as taken", "5 as target")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    out = quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert out.columns == [*docs.columns, "quality_score", "quality_kept"] and out.count() == docs.count()
    assert neardup.one_of_each(docs).columns == docs.columns
    assert decontam.without_leaks(docs, benchmark).count() == docs.count() - 1
    assert pii.redact_pii(docs).columns == docs.columns
    assert corpus_pipeline.mixing_stage(spark, docs, folder).columns == [*docs.columns, "mix_epoch", "mix_target", "mix_taken"]


#: Names that the operators use inside or give to their results.
CLASHES = (
    "id", "copy", "group", "node", "row_id", "row_copy", "path", "host", "p", "path_key", "path_rate", "Log_Ratio", "quality_score", "quality_kept",
    "mix_source", "mix_size", "mix_copy", "mix_epoch", "mix_target", "mix_taken", "plan_id", "source_key")


def test_every_given_column_keeps_its_values(spark, folder):
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    docs = plain.select("*", *[F.lit(n).alias(name) for n, name in enumerate(CLASHES)])
    marks = [F.col(name) == n for n, name in enumerate(CLASHES)]
    for _, stage in corpus_pipeline.STAGES:
        out, without = stage(spark, docs, folder), stage(spark, plain, folder)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert out.where(~F.forall(F.array(*marks), lambda x: x)).count() == 0
        assert rows_of(out.select(*plain.columns)) == rows_of(without.select(*plain.columns))
    assert out.columns[-2:] == ["_mix_target", "_mix_taken"]
