"""Components against an eigendecomposition of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tallybook.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>, n string"


def plain(vectors, most):
    """Steps by row, n, eigenvalues and unit eigenvectors over the different vectors."""
    steps = [[math.floor(256 * c) for c in v] for v in vectors]
    fit = [list(v) for v in dict.fromkeys(map(tuple, steps))]
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    cov = [[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n**3)) for j in range(d)] for i in range(d)]
    e, vectors = np.linalg.eigh(np.array(cov))
    return steps, n, sums, e[::-1][:most], vectors[:, ::-1][:, :most], float(np.trace(np.array(cov)))


def compare(rows, out, most=4):
    steps, n, sums, e, vectors, trace = plain([r[1] for r in rows], most)
    got = {(r.vec_id, r.component): r for r in out}
    kept = int((e > 1e-9 * e[0]).sum())
    assert len(out) == len(rows) * kept and {r.component for r in out} == set(range(1, kept + 1))
    for (vec_id, *_), x in zip(rows, steps, strict=True):
        off = [n * a - s for a, s in zip(x, sums, strict=True)]
        for k in range(kept):
            r = got[vec_id, k + 1]
            sign = math.copysign(1, sum(got[i[0], k + 1].whitened * (np.array(y) - np.array(sums) / n) @ vectors[:, k] for i, y in zip(rows, steps, strict=True)))
            want = sign * float((np.array(off, float) / n) @ vectors[:, k]) / math.sqrt(e[k])
            assert r["_n"] == n
            assert int(r.deviation) == sum(o * o for o in off)
            assert r.whitened == pytest.approx(want, abs=1e-6)
            assert r.explained == pytest.approx(e[k] / trace, rel=1e-9)
            assert r.identity_error < 1e-9


def run(spark, rows, **more):
    return whitening.whitened(spark.createDataFrame(rows, SCHEMA), **more).collect()


def random_rows(seed, n, d, scale=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (scale ** np.arange(d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    return [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]


def test_like_the_covariance(spark):
    rows = random_rows(1, 200, 8, 0.7)
    rows += [(1000 + i, rows[3][1], "x") for i in range(60)]  # copies count once in the fit
    compare(rows, run(spark, rows))


def test_dependent_dimensions(spark):
    rows = [(i, [*v[:3], v[0], 0.25], "x") for i, v, _ in random_rows(2, 50, 3)]
    compare(rows, run(spark, rows, most=9), most=9)


def test_unusable_rows_are_dropped(spark):
    rows = random_rows(3, 40, 3)
    bad = [(100, None, "x"), (101, [1.0, None, 0.0], "x"), (102, [1.0, float("nan"), 0.0], "x"), (103, [float("inf"), 0.0, 0.0], "x"),
           (104, [1.0], "x"), (105, [], "x"), (106, [1e300, 0.0, 0.0], "x")]
    compare(rows, run(spark, rows + bad))


def test_exact_with_large_entries(spark):
    rows = [(i, [float(2**40 + i * 3), float(-(2**41) + i * i)], "x") for i in range(30)]
    _, n, sums, *_ = plain([r[1] for r in rows], 2)
    for r in run(spark, rows):
        x = [math.floor(256 * c) for c in rows[r.vec_id][1]]
        assert int(r.deviation) == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], "x")], [(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x")], [(1, None, "x")], [(1, [], "x")]])
def test_nothing_to_whiten(spark, rows):
    assert run(spark, rows) == []


def test_columns_keep_their_names(spark):
    out = whitening.whitened(spark.createDataFrame(random_rows(4, 20, 2), SCHEMA))
    assert out.columns == ["vec_id", "embedding", "n", "_n", "deviation", "component", "whitened", "explained", "identity_error"]


def test_triangular_solves():
    rng = np.random.default_rng(5)
    factors = [np.triu(rng.normal(size=(5, 5))) + 3 * np.eye(5) for _ in range(2)]
    rows = rng.normal(size=(9, 5))
    assert np.allclose(whitening.solved(rows, factors), rows @ np.linalg.inv(factors[0]) @ np.linalg.inv(factors[1]))
