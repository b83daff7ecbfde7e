"""Whitening of embeddings by shifted CholeskyQR over distributed Gram passes.

Entries become whole numbers, ``floor(scale * c)``, and each distinct vector counts
once. With the rows centred, every pass sums the Gram matrix of the rows as they stand,
the driver takes its Cholesky factor, and the next pass solves the rows against all
factors so far (triangular solves in the tasks; no inverse is made). The first factor is
taken of the Gram matrix plus a shift, so that nearly or fully dependent columns do not
break it down; later ones only while the matrix is still singular to working precision.
The passes end when the rows are orthonormal on their span. The product R of the factors
is small; its singular vectors and values are the components and their spread.

Rows are dropped whose vector is null, or holds null or non-finite entries, or has another
length than most vectors (the longer length on a tie). Directions without spread (below
1e-14 of the largest) make no component, so a table of equal vectors, or an empty one,
gives no rows. Null ids stay, repeated rows are answered one by one. The driver holds
matrices of the vectors' length squared, nothing that grows with the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixweave.llm.arrow import Shared, record_batch
from fixweave.session import staged

SCALE, COMPONENTS = 256, 4
# Passes at most; four are enough unless millions of rows meet dependent columns.
PASSES = 12
# Least variance of a component, as a share of the largest.
FLAT = 1e-14
# Distance from orthonormal rows at which the passes end at once, or when it falls no more.
ORTHONORMAL, NEAR = 1e-13, 1e-8

_EPS = np.finfo(float).eps
_LONG = (1 << 63) - 1


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x``, the vector as whole numbers, of the rows that count."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return df.where(vector.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


_HALVES = "dim int, high long, low long"


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, width)
                halves = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
                yield record_batch(_HALVES, np.arange(-1, width), np.append(0, halves[0]), np.append(len(x), halves[1]))

    added = fit.mapInArrow(run, _HALVES).groupBy("dim").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    total = {r["dim"]: (r["high"] << 32) + r["low"] for r in added.collect()}
    return total.get(-1, 0), [total.get(i, 0) for i in range(width)]


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The rows q with q R = rows, for an upper triangular R."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


class Centred:
    """Turns whole vectors into centred rows, and these into other rows."""

    def __init__(self, count: int, sums: list[int], factors: list[np.ndarray], axes: np.ndarray | None = None):
        self.mean = np.array([s / count for s in sums])
        self.factors, self.axes = factors, axes

    def rows(self, x: np.ndarray) -> np.ndarray:
        out = x - self.mean
        for factor in self.factors:
            out = solved(out, factor)
        return out if self.axes is None else out @ self.axes


_CELL = "cell int, value double"


def _gram(fit: DataFrame, width: int, centred: Centred, size: int) -> np.ndarray:
    """Sum over the fit list of the products of each two columns of its rows."""
    held = Shared(fit.sparkSession, centred)

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                rows = held.value.rows(_matrix(batch, width))
                total += rows.T @ rows
        upper = np.triu_indices(size)
        yield record_batch(_CELL, upper[0] * size + upper[1], total[upper])

    out = np.zeros((size, size))
    for cell, value in fit.mapInArrow(run, _CELL).groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[cell // size, cell % size] = out[cell % size, cell // size] = value
    held.close()
    return out


def triangular_factors(gram, count: int, width: int, passes: int = PASSES) -> list[np.ndarray]:
    """Factors R1, R2, ... whose product is the R of the rows; ``gram`` gives the matrix after some factors."""
    factors: list[np.ndarray] = []
    last = np.inf
    while len(factors) < passes:
        matrix = gram(factors)
        largest = np.linalg.norm(matrix, 2)
        if not largest:
            break
        if factors:
            away = np.abs(matrix @ matrix - matrix).max()
            if away <= ORTHONORMAL or away <= NEAR and away > last / 4:
                break
            last = away
            singular = np.linalg.eigvalsh(matrix)[0] < 1e-8 * largest
            shift = 11 * width * (width + 1) * _EPS * largest if singular else 0.0
        else:
            shift = 11 * (count * width + width * (width + 1)) * _EPS * largest
        factors.append(np.linalg.cholesky(matrix + shift * np.eye(width)).T)
    return factors


class Whitening:
    """Components of a fit list, by falling variance."""

    def __init__(self, count: int, sums: list[int], factors: list[np.ndarray], components: int):
        self.count, self.sums, width = count, sums, len(sums)
        self.axes, self.variance, self.share = np.zeros((width, 0)), np.zeros(0), np.zeros(0)
        if factors:
            whole = np.eye(width)
            for factor in factors:
                whole = factor @ whole
            _, spread, axes = np.linalg.svd(whole)
            variance = spread**2 / count
            kept = [i for i in range(min(components, width)) if variance[i] > FLAT * variance[0]]
            self.axes, self.variance = axes[kept].T, variance[kept]
            self.share = self.variance / variance.sum()
        self.error = 0.0

    def centred(self) -> Centred:
        return Centred(self.count, self.sums, [], self.axes / np.sqrt(self.variance))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S)**2 per row; null where it is no long."""
        most = max([abs(s) for s in self.sums] + [0]) + self.count * max(int(x.max()), -int(x.min()))
        if most * most * x.shape[1] <= _LONG:
            return ((self.count * x - np.array(self.sums)) ** 2).sum(1).tolist()
        exact = ((self.count * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1).tolist()
        return [v if v <= _LONG else None for v in exact]


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, int]:
    """Whitening of the distinct vectors ``x`` of most vectors' length, and that length."""
    length = F.size("x").alias("length")
    common = vectors.groupBy(length).count().orderBy(F.desc("count"), F.desc("length")).first()
    if common is None or not common["length"]:
        return None, 0
    width = common["length"]
    fit = staged(vectors.where(F.size("x") == width).select("x").distinct(), "whitening")
    count, sums = _sums(fit, width)

    def gram(factors):
        return _gram(fit, width, Centred(count, sums, factors), width)

    fitted = Whitening(count, sums, triangular_factors(gram, count, width), components)
    size = fitted.axes.shape[1]
    if size:
        covariance = _gram(fit, width, fitted.centred(), size) / count
        fitted.error = float(np.abs(covariance - np.eye(size)).max())
    return fitted, width


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS
) -> DataFrame:
    """One row per vector and component: the whitened coordinate and what the component explains."""
    vectors = whole_vectors(df, id_col, vector_col, scale)
    fitted, width = fit_whitening(vectors, components)
    if fitted is None or not fitted.axes.shape[1]:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    held = Shared(df.sparkSession, fitted)

    def run(batches):
        model = held.value
        project, size = model.centred().rows, model.axes.shape[1]
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, width)
                per_row = [v for v in model.deviation(x) for _ in range(size)]
                ids = [v for v in batch.column("vec_id").to_pylist() for _ in range(size)]
                yield record_batch(
                    _SCHEMA, ids, np.tile(np.arange(1, size + 1), len(x)), np.full(len(ids), model.count), per_row,
                    project(x).reshape(-1), np.tile(model.share, len(x)), np.full(len(ids), model.error),
                )

    return vectors.where(F.size("x") == width).mapInArrow(run, _SCHEMA)
