"""The manifest against a plain tree over sorted rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallybook.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars, _ = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def proofs(digests):
    """Root of a tree and the siblings of each leaf, level by level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, p in enumerate(at):
            paths[i] += level[p ^ 1 : (p ^ 1) + 1]
            at[i] = p // 2
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *proofs([leaf(r) for r in mine])))
    root, above = proofs([t[1] for t in trees])
    return sorted((r[0] is not None, r[0] or 0, leaf(r), sub, root, h(*path, *rest))
                  for (mine, sub, paths), rest in zip(trees, above, strict=True) for r, path in zip(mine, paths, strict=True))


def found(spark, rows, bits):
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), bits=bits)
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof"), merkle.fold(F.col("leaf"), F.col("path")).alias("folded"))
    rows = out.collect()
    assert all(r.folded == r.root for r in rows)
    return sorted((r.doc_id is not None, r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof) for r in rows)


def rows_of(seed, n):
    rng = random.Random(seed)
    ids = [None, -1, -(2**63), 2**63 - 1, 63, 64, 65_536, 2**32, 2**48 + 5, *range(-70, 70)]
    texts = [None, "", "a", "täxt", "x" * 50_000]
    rows = [(rng.choice(ids), rng.choice(texts), rng.choice([None, "", "en", "zh", "é"]), rng.choice([None, "s", ""]), rng.choice([None, 0, 7]), 1) for _ in range(n)]
    return rows + rows[: n // 5]


@pytest.mark.parametrize(("n", "bits"), [(150, 2), (90, 9)])
def test_like_a_plain_tree(spark, n, bits):
    rows = rows_of(n, n)
    assert found(spark, rows, bits) == plain(rows)


def test_one_id_and_equal_rows(spark):
    rows = [(7, "same", "en", "s", 1, 1)] * 40 + [(7, f"t{i}", "en", "s", 1, 1) for i in range(30)] + [(None, None, None, None, None, None)] * 9
    assert found(spark, rows, 3) == plain(rows)


def test_one_row_and_none(spark):
    rows = [(5, "t", "en", "s", 1, 1)]
    assert found(spark, rows, 4) == plain(rows)
    assert found(spark, [], 4) == []


def test_tampering_shows(spark):
    rows = [(i, f"t{i}", "en", "s", i, 1) for i in range(21)]
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.when(F.col("doc_id") == 3, F.sha2("text", 256)), bits=2)
    out = out.withColumn("folded", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    assert {r.doc_id for r in out.collect() if r.folded != r.root} == {3}


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError, match="integer"):
        merkle.manifest(spark.createDataFrame([("a", "t", "en", "s", 1, 1)], SCHEMA.replace("doc_id bigint", "doc_id string")))
