"""Whitening components of an embedding table by shifted Cholesky QR.

The centred rows ``A`` are never gathered.  Three distributed Gram passes orthogonalise them:
each task solves its rows against the triangular factors found so far and adds up their Gram
matrix, and the small factors compose to ``R`` with ``A = Q R``.  The singular value
decomposition of ``R`` has the right singular vectors and values of ``A``.  A plain
eigendecomposition of the covariance would square the condition number; this does not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from tallybook.llm.common import columns_of, free_name, map_batches
from tallybook.session import materialize

PASSES = 3


@dataclass(frozen=True)
class Whitening:
    """Mean and components of a fit list of ``n`` different vectors (sums are exact)."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        """Dimensions x components: centred rows times this have the identity as covariance."""
        return self.components / np.sqrt(self.eigenvalues)


def steps_of(vector: str, scale: int = 256) -> Column:
    """The vector in whole steps, floor(scale * entry) as longs; null where it is not usable.

    Not usable are null vectors and those that hold an entry that is null, not finite or
    too large for a long.
    """
    scaled = F.transform(vector, lambda c: c.cast("double") * scale)
    fits = F.forall(scaled, lambda c: c.isNotNull() & (c >= -(2.0**63)) & (c < 2.0**63))  # NaN is the largest
    return F.when(fits, F.transform(scaled, lambda c: F.floor(c)))


def usable(rows: DataFrame, vector: str, name: str, scale: int = 256) -> DataFrame:
    """``rows`` with the whole-step vectors as ``name``; rows without one are dropped.

    Of vectors of several lengths those of the most frequent one stay (the longest of those).
    """
    found = rows.withColumn(name, steps_of(vector, scale)).where(F.col(name).isNotNull())
    sizes = found.groupBy(F.size(name).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    size = sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return found.where(F.size(name) == (size or 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of equally long lists as one matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _centred(steps: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return steps - np.array([s / n for s in sums])


def _exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and the sum of each dimension, as whole numbers of any size.

    High and low halves are added as longs in each batch; batches add up as decimals.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            steps = _matrix(batch.column(0))
            if len(steps):
                part = (steps >> 32).sum(0).astype(object) * 2**32 + (steps & 0xFFFFFFFF).sum(0).astype(object)
                n, total = n + len(steps), part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(total)), pa.int32()), pa.array([str(v) for v in (n, *total)])], names=["i", "v"])

    parts = map_batches(fit, work, "i int, v string")
    sums = dict(parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string")).collect())
    return int(sums.pop(-1, 0)), [int(sums[i]) for i in sorted(sums)]


def _added(parts: DataFrame, d: int) -> np.ndarray:
    """Matrices of partitions (i, row) added up, in an order that their values fix."""
    def work(rows: pa.Table) -> pa.Table:
        values = np.sort(np.array(rows["row"].to_pylist()).reshape(len(rows), -1), axis=0).sum(0)
        return pa.table({"i": rows["i"][:1].combine_chunks(), "row": pa.array([values], pa.list_(pa.float64()))})

    out = np.zeros((d, d))
    for i, row in parts.groupBy("i").applyInArrow(work, "i int, row array<double>").collect():
        out[i] = row
    return out


def _gram(fit: DataFrame, d: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of the outer products of ``rows_of`` the vectors."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                rows = rows_of(_matrix(batch.column(0)))
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    return _added(map_batches(fit, work, "i int, row array<double>"), d)


def solved(rows: np.ndarray, upper: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverses of upper triangular factors, one triangular solve each."""
    for r in upper:
        out = np.empty_like(rows)
        for j in range(r.shape[0]):  # columns one by one: all rows of the batch at once
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _factor(gram: np.ndarray, shift: float) -> np.ndarray | None:
    """Upper Cholesky factor of a shifted Gram matrix, none where it has none."""
    try:
        return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
    except np.linalg.LinAlgError:
        return None


def composed_factor(gram_of: Callable[[list[np.ndarray]], np.ndarray], n: int, d: int) -> np.ndarray:
    """``R`` of the centred rows, from Gram matrices of rows solved against the factors so far.

    The first factor is shifted by 11 (n d + d (d + 1)) u |A|^2, which lets it exist for any
    rows, also dependent ones.  Where the last Gram matrix is singular (dependent dimensions
    leave no unit columns), its symmetric root takes the place of the Cholesky factor:
    ``R`` stays exact, and the missing directions get the value 0.
    """
    factors: list[np.ndarray] = []
    whole = np.eye(d)
    for place in range(PASSES):
        gram = gram_of(factors)
        shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
        r = _factor(gram, 0.0 if place else shift)
        if r is None or place == PASSES - 1 and not np.allclose(np.diag(gram), 1, atol=0.1):
            values, vectors = np.linalg.eigh(gram)
            values[values < d * np.finfo(float).eps * max(values[-1], 0)] = 0
            return np.sqrt(values)[:, None] * vectors.T @ whole
        factors.append(r)
        whole = r @ whole
    return whole


def fit_whitening(fit: DataFrame, most: int | None = None) -> Whitening | None:
    """Components of a table of different whole-step vectors (its only column).

    By falling eigenvalue, ``most`` of them at most; those whose eigenvalue is 0 within the
    rounding of doubles have no whitened value and are left out.  None without vectors or
    dimensions.
    """
    n, sums = _exact_sums(fit)
    d = len(sums)
    if not n or not d:
        return None
    r = composed_factor(lambda factors: _gram(fit, d, lambda steps: solved(_centred(steps, n, sums), factors)), n, d) / np.sqrt(n)
    _, sigma, vectors = np.linalg.svd(r)
    e = sigma**2
    kept = int((sigma > d * np.finfo(float).eps * sigma[0]).sum())
    kept = kept if most is None else min(kept, most)
    return Whitening(n, sums, vectors[:kept].T, e[:kept], float(e.sum()))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity.

    The whitened values are centred by their own mean before they are multiplied.
    """
    k = model.components.shape[1]
    n, sums, matrix = model.n, model.sums, model.matrix
    if not k:
        return 0.0

    def whiten(steps: np.ndarray) -> np.ndarray:
        return _centred(steps, n, sums) @ matrix

    def with_one(steps: np.ndarray) -> np.ndarray:
        return np.hstack([whiten(steps), np.ones((len(steps), 1))])

    mean = _gram(fit, k + 1, with_one)[k, :k] / n
    covariance = _gram(fit, k, lambda steps: whiten(steps) - mean) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(rows: DataFrame, vector: str = "embedding", most: int = 4, scale: int = 256) -> DataFrame:
    """``rows`` with ``n, deviation, component, whitened, explained, identity_error``.

    Vectors count in whole steps, floor(scale * entry).  The fit list holds each different one
    once.  One output row for each row and component (numbered from 1 by falling eigenvalue,
    at most ``most``): the row less the mean, projected on the unit eigenvector of the fit
    list's covariance, over the root of the eigenvalue; ``explained`` is the eigenvalue's share
    of the trace.  ``deviation`` is the sum over dimensions of (n * x - S)^2, exact.

    Rows whose vector is null, or holds an entry that is null, not finite or too large for a
    long, are dropped, as are those of another length than the most frequent one.  Repeated
    rows are all returned and count once in the fit; other columns are kept, whatever their names.
    Components with eigenvalue 0 don't exist: where all rows are equal, or there are none,
    nothing is returned.
    """
    name = free_name(rows, "steps")
    given = usable(rows, vector, name, scale)
    fit = materialize(given.select(name).distinct())
    model = fit_whitening(fit, most)
    names = {c: free_name(rows, c) for c in ("n", "deviation", "component", "whitened", "explained", "identity_error")}
    place = given.columns.index(name)
    error = identity_error(fit, model) if model else 0.0
    n, sums = (model.n, model.sums) if model else (0, [])
    matrix = model.matrix if model else np.zeros((0, 0))
    share = [float(v) for v in model.eigenvalues / model.trace] if len(matrix) else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, object)
        for batch in batches:
            steps = _matrix(batch.column(place))
            if not steps.size or not matrix.size:
                continue
            most_off = n * max(abs(int(steps.max())), abs(int(steps.min()))) + max(map(abs, sums))
            # Longs where they hold every square and their sum, whole numbers of any size elsewhere.
            small = len(sums) * most_off**2 < 2**63
            off = n * steps - total.astype(np.int64) if small else n * steps.astype(object) - total
            values = _centred(steps, n, sums) @ matrix
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([str(v) for v in (off * off).sum(1)]), pa.array(list(values), pa.list_(pa.float64()))],
                names=[*batch.schema.names, deviation, listed])

    deviation, listed, at = names["deviation"], free_name(given, "values"), free_name(given, "place")
    schema = StructType(list(given.schema.fields)).add(deviation, StringType()).add(listed, ArrayType(DoubleType()))
    found = map_batches(given, work, schema)
    found = found.select(*columns_of(rows), deviation, F.posexplode(listed).alias(at, names["whitened"]))
    return found.select(
        *columns_of(rows), F.lit(n).cast("bigint").alias(names["n"]), F.expr(f"try_cast({deviation} AS decimal(38,0))").alias(deviation),
        (F.col(at) + 1).alias(names["component"]), names["whitened"],
        F.get(F.array(*map(F.lit, share)).cast("array<double>"), F.col(at)).alias(names["explained"]), F.lit(error).alias(names["identity_error"]))
