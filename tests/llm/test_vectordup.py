"""Links and components of vectors against all pairs."""

import numpy as np
import pytest

from tallybook.llm import vectordup

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, cosine):
    """Every row's number of links, component and whether it is kept, by all pairs."""
    usable = lambda v: v and all(c is not None and np.isfinite(np.float32(c)) for c in v) and any(v)
    units = []
    for _, v, _ in rows:
        v = np.array(v, np.float32).astype(float) if usable(v) else None
        units.append(None if v is None else v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()))
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]):
                linked[i, j] = units[i] @ units[j] >= cosine
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(linked), strict=True):
        root[top(i)] = top(j)
    low = lambda d: (d is not None, d or 0)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0], key=low)
    return sorted(((r[0], int(linked[i].sum()), least[top(i)], r[0] == least[top(i)]) for i, r in enumerate(rows)), key=str)


def found(spark, rows, **more):
    out = vectordup.near_duplicates(spark.createDataFrame(rows, SCHEMA), **more).collect()
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=str)


def clustered(seed, groups, noise, d=16):
    """Clusters of given sizes, members off their centre by ``noise``; their labels say nothing."""
    rng = np.random.default_rng(seed)
    rows = []
    for size in groups:
        center = rng.normal(size=d)
        center /= np.linalg.norm(center)
        for v in center + noise * rng.normal(size=(size, d)) / np.sqrt(d):
            rows.append((len(rows) * 7 % 1009, [float(np.float32(c)) for c in 3 * v], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize(("groups", "noise"), [([60, 1, 2, 3] + [1] * 40, 0.08), ([70] + [1] * 20, 0.25)])
def test_like_all_pairs(spark, groups, noise):
    # Wide groups leave many links open between the bounds; small blocks cut them up.
    rows = clustered(3, groups, noise)
    assert found(spark, rows, block=8, miss=1e-7) == brute(rows, 0.95)


def test_awkward_rows(spark):
    a = [0.5, -0.25, 0.0, 1.0]
    rows = [(1, a, 1), (1, a, 2), (None, a, 3), (4, [2 * c for c in a], 1), (5, [0.5, -0.25, -0.0, 1.0], 1), (6, None, 1), (7, [], 1), (8, [0.0] * 4, 1),
            (9, [1.0, None, 0.0, 0.0], 1), (10, [float("nan"), 1.0, 0.0, 0.0], 1), (11, [float("inf"), 1.0, 0.0, 0.0], 1), (12, [1.0], 1), (13, [3.0], 1),
            (14, [-1.0], 1), (15, [c * 1e-38 for c in a], 1), (16, [c * 1e38 for c in a], 1), (17, [1.0, 1.0], 1), (6, None, 2)]
    assert found(spark, rows) == brute(rows, 0.95)
    assert found(spark, []) == []


def test_doubles_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 5, 5, 5), (2, [1.0, 1e-9], 6, 6, 6)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, num int, node int, kept int")
    assert {tuple(r) for r in vectordup.near_duplicates(df).collect()} == {(1, 1, 1, True), (2, 1, 1, False)}


def test_pairs_at_the_threshold_share_a_bucket():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    parts, tables = vectordup.hash_plan(50_000, 64, 0.95, 1e-4)
    met = np.zeros(3000, bool)
    for t in range(tables):
        x, y = vectordup.buckets(a, t, parts), vectordup.buckets(b, t, parts)
        met |= (x[:, :, None] == y[:, None, :]).any((1, 2))
    assert met.mean() >= 0.999


def test_the_transform_keeps_lengths_and_its_inverse_is_itself():
    x = np.random.default_rng(1).normal(size=(5, 32)).astype(np.float32)
    y = vectordup.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), rtol=1e-5)
    assert np.allclose(vectordup.hadamard(y), x, atol=1e-5)
