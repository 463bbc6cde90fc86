"""Whitening of embeddings by the leading eigenvectors of their covariance.

Components become whole numbers. The covariance is that of the distinct vectors: exact sums first,
then every task adds up products of its centred rows, so what Spark gathers is one matrix. The driver
brings it to tridiagonal form by Householder reflections, finds the leading eigenvalues by bisection
on Sturm counts and their vectors by inverse iteration, orthogonal within clusters. The vectors are
broadcast and every row is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm import vectors as V
from plaudit.plans.session import durable, ship_package

SCALE = 256
COMPONENTS = 4
# The covariance, width * width doubles, is held by the driver and by each task.
MAX_WIDTH = 4096
# Whole numbers that a double holds.
LIMIT = 1 << 53
# Components of less than this share of the largest variance are left out: rounding decides them.
LEAST = 1e-11
_EPS = np.finfo(np.float64).eps


# --- eigenvectors of a symmetric matrix ------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: diagonal, off-diagonal, and the unit vectors of the reflections, one a column."""
    a = np.array(matrix, np.float64)
    n = len(a)
    reflections = np.zeros((n, max(n - 2, 0)))
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        reflections[k + 1 :, k] = v
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``."""
    squares = np.concatenate(([0.0], off * off))
    least = 1e-290 * max(1.0, squares.max())
    pivot = np.ones(len(at))
    below = np.zeros(len(at), np.int64)
    for d, s in zip(diagonal, squares, strict=True):
        pivot = d - at - s / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest, falling, each bisected until no double lies between its bounds."""
    n = len(diagonal)
    around = np.concatenate(([0.0], np.abs(off))) + np.concatenate((np.abs(off), [0.0]))
    reach = max(np.abs(diagonal - around).max(), np.abs(diagonal + around).max(), np.finfo(np.float64).tiny) * (1 + 4 * _EPS)
    low, high = np.full(count, -reach), np.full(count, reach)
    wanted = n - np.arange(count)  # of the i-th largest, n - i lie below whatever is above it
    while True:
        middle = low + (high - low) / 2
        between = (middle > low) & (middle < high)
        if not between.any():
            return middle
        above = sturm_counts(diagonal, off, middle) >= wanted
        high = np.where(between & above, middle, high)
        low = np.where(between & ~above, middle, low)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) y = b by elimination with row exchanges."""
    n = len(diagonal)
    scale = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(np.float64).tiny)
    d, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    factors, swaps = [0.0] * n, [False] * n
    for i in range(n - 1):
        below = float(off[i])
        if abs(below) > abs(d[i]):
            swaps[i] = True
            factors[i] = d[i] / below
            d[i], upper[i], second[i], kept = below, d[i + 1], upper[i + 1], upper[i]
            d[i + 1] = kept - factors[i] * upper[i]
            upper[i + 1] = -factors[i] * second[i]
        else:
            if abs(d[i]) < _EPS * scale:
                d[i] = _EPS * scale
            factors[i] = below / d[i]
            d[i + 1] -= factors[i] * upper[i]
    if abs(d[-1]) < _EPS * scale:
        d[-1] = _EPS * scale

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.tolist()
        for i in range(n - 1):
            if swaps[i]:
                y[i], y[i + 1] = y[i + 1], y[i] - factors[i] * y[i + 1]
            else:
                y[i + 1] -= factors[i] * y[i]
        for i in range(n - 1, -1, -1):
            y[i] -= (upper[i] * y[i + 1] if i + 1 < n else 0.0) + (second[i] * y[i + 2] if i + 2 < n else 0.0)
            y[i] /= d[i]
        return np.array(y)

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one a column.

    Values closer than a thousandth of the norm form a cluster, whose vectors are kept orthogonal.
    """
    n = len(diagonal)
    norm = max((np.abs(diagonal) + np.concatenate((np.abs(off), [0])) + np.concatenate(([0], np.abs(off)))).max(), np.finfo(np.float64).tiny)
    rng = np.random.default_rng(0)
    out = np.zeros((n, len(values)))
    first, shift = 0, np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            first = i
        # Equal values are set apart a little, so that each has a solver of its own.
        shift = min(value, shift - 2 * _EPS * norm) if i > first else value
        solve = _solver(diagonal, off, shift)
        y = rng.uniform(-1, 1, n)
        for _ in range(5):
            for _ in range(2):
                y -= out[:, first:i] @ (out[:, first:i].T @ y)
            y = solve(y / np.linalg.norm(y))
        for _ in range(2):
            y -= out[:, first:i] @ (out[:, first:i].T @ y)
        out[:, i] = y / np.linalg.norm(y)
    return out


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors, one a column, whose largest entry is positive."""
    scale = np.abs(matrix).max(initial=0)
    if scale == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, min(count, len(matrix)))
    found = inverse_iteration(diagonal, off, values)
    for k in range(reflections.shape[1] - 1, -1, -1):
        v = reflections[:, k]
        found -= 2 * np.outer(v, v @ found)
    largest = np.abs(found).argmax(0)
    return values * scale, found * np.sign(found[largest, np.arange(found.shape[1])])


# --- moments over all rows -------------------------------------------------------------------------


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums as whole numbers, exact, and the same divided by n as doubles."""
    if len(x) and n * (int(np.abs(x).max()) + 1) + max(map(abs, sums)) >= 1 << 62:
        exact = x.astype(object) * n - np.array(sums, object)
        return exact, (exact / n).astype(np.float64)
    exact = x * n - np.array(sums, np.int64)
    return exact, exact / n


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors, and the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = V.as_matrix(batch.column("x"))
            if not len(x):
                continue
            if total is not None and len(total) != x.shape[1]:
                raise ValueError("vectors of several widths")
            # Halves of the numbers add up without running over.
            high, low = (x >> 26).sum(0), (x & (1 << 26) - 1).sum(0)
            some = [(int(h) << 26) + int(v) for h, v in zip(high, low, strict=True)]
            total = some if total is None else [a + b for a, b in zip(total, some, strict=True)]
            n += len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), pa.array([[Decimal(v) for v in total]], pa.list_(pa.decimal128(38, 0)))],
                ["n", "total"],
            )

    parts = fit.mapInArrow(run, "n long, total array<decimal(38,0)>")
    found = (
        parts.select("n", F.posexplode("total")).groupBy("pos")
        .agg(F.sum("n").alias("n"), F.sum("col").alias("total")).orderBy("pos").collect()  # one row a component
    )
    if len({row["n"] for row in found}) > 1:
        raise ValueError("vectors of several widths")
    return (found[0]["n"] if found else 0), [int(row["total"]) for row in found]


def covariance(fit: DataFrame, n: int, sums: list[int], axes: np.ndarray | None = None) -> np.ndarray:
    """The covariance, divisor n, of the centred vectors, or of these along ``axes``."""
    width = len(sums) if axes is None else axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            _, y = centred(V.as_matrix(batch.column("x")), n, sums)
            if len(y):
                y = y if axes is None else y @ axes
                total += y.sum(0)
                products += y.T @ y
        yield V.totals({-1: total, **dict(enumerate(products))})

    found = V.added(fit.mapInArrow(run, V.SUMS), np.float64, fit.rdd.getNumPartitions())
    mean = found[-1] / n  # 0 but for rounding
    out = np.array([found[i] for i in range(width)]) / n - np.outer(mean, mean)
    return (out + out.T) / 2


@dataclass
class Whitening:
    """What the vectors were fitted to; of fixed size."""

    n: int
    sums: list[int]
    values: np.ndarray  # variance along each component, falling
    axes: np.ndarray  # one unit vector a column
    trace: float
    identity_error: float | None


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vector_col: str = "embedding") -> Whitening:
    """Fits to the distinct whole-number vectors of all rows.

    Without rows, or where all vectors are equal, there is no component. The written table of
    distinct vectors is read three times: for sums, covariance, and the error of the result.
    """
    ship_package(rows.sparkSession)
    if components < 1:
        raise ValueError("components must be 1 or more")
    x = V.quantised(rows.select(F.col(vector_col).alias("vector")), "vector", scale, LIMIT)
    fit = durable(x.distinct(), "whitening-fit")
    n, sums = exact_sums(fit)
    if len(sums) > MAX_WIDTH:
        raise ValueError(f"vectors of {len(sums)} components; at most {MAX_WIDTH} are possible")
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((0, 0)), 0.0, None)
    matrix = covariance(fit, n, sums)
    values, axes = leading_components(matrix, components)
    real = values > LEAST * max(values.max(initial=0), 0)
    values, axes = values[real], axes[:, real]
    error = None
    if len(values):
        error = float(np.abs(covariance(fit, n, sums, axes / np.sqrt(values)) - np.eye(len(values))).max())
    return Whitening(n, sums, values, axes, float(np.trace(matrix)), error)


def whiten(
    rows: DataFrame, fitted: Whitening, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A row whose vector is null, empty or not finite gives nothing; repeated rows and null ids are
    kept. Vectors of several widths raise ValueError, as do components beyond 2**45 or so.
    ``deviation`` is exact, and null where it is no long.
    """
    ship_package(rows.sparkSession)
    k = len(fitted.values)
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    held = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for batch in batches:
            exact, y = centred(V.as_matrix(batch.column("x")), f.n, f.sums)
            rows = len(y)
            if not rows:
                continue
            if exact.dtype == object or float(np.abs(exact).max()) ** 2 * exact.shape[1] >= 1 << 62:
                exact = exact.astype(object)
                deviations = [v if v < 1 << 63 else None for v in (exact * exact).sum(1).tolist()]
            else:
                deviations = (exact * exact).sum(1)
            deviation = pa.array(deviations, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, f.n)), deviation,
                    pa.array((y @ f.axes / np.sqrt(f.values)).reshape(-1)), pa.array(np.tile(f.values / f.trace, rows)),
                    pa.array(np.full(rows * k, f.identity_error)),
                ],
                names,
            )

    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    return V.quantised(picked, "vector", scale, LIMIT).mapInArrow(run, schema)
