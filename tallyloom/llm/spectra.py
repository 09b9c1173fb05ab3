"""Embedding whitening by incremental eigendecomposition.

The scatter matrix of a table is never formed. A task keeps the spectrum of the rows it has seen
(eigenvalues and vectors of their centred scatter, mean, count); every vector changes it by a
centred rank-one update, whose eigenvalues are the roots of a secular equation and which leaves
alone what deflation finds untouched. Spectra of tasks are combined by successive rank-one
updates, a few at a time, and a Rayleigh-Ritz step over all rows brings the components to
double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import durable

EPS, TINY = np.finfo(float).eps, np.finfo(float).tiny
OFFSET = 1_000_000
#: Rows rotated together, spectra combined in one task.
BATCH, FAN = 4_096, 16
SPECTRUM = "id long, n long, sums array<long>, values array<double>, vectors array<double>"


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)), as index of the nearest pole and distance from it.

    ``poles`` rise strictly and ``weights`` are positive; root i lies between poles i and i + 1,
    the last one beyond the last pole by at most the sum of the weights. Distances are kept apart
    from the poles so that differences between roots and poles are exact to working precision.
    """
    n = len(poles)
    gaps = np.append(np.diff(poles), weights.sum())
    middle = poles + gaps / 2
    at_middle = 1 + (weights / (poles - middle[:, None])).sum(1)
    # The function rises from pole to pole: positive at the middle means a root in the lower half.
    nearest = np.where((at_middle >= 0) | (np.arange(n) == n - 1), np.arange(n),
                       np.minimum(np.arange(n) + 1, n - 1))
    shifted = poles - poles[nearest][:, None]
    below = nearest == np.arange(n)
    low = np.where(below, 0.0, -gaps / 2)
    high = np.where(below, np.where(np.arange(n) == n - 1, gaps, gaps / 2), 0.0)
    x = (low + high) / 2
    own = weights[nearest]
    rows = np.arange(n)
    for _ in range(120):
        away = shifted - x[:, None]
        away[away == 0] = TINY
        terms = weights / away
        value = 1 + terms.sum(1)
        # What rounding alone may leave of the value at a root.
        exact = np.abs(value) <= EPS * (1 + np.abs(terms).sum(1))
        low, high = np.where(value <= 0, x, low), np.where(value >= 0, x, high)
        # The nearest pole is kept whole and the rest taken as a line: a quadratic for the root.
        slope_rest = (terms / away).sum(1) - own / away[rows, nearest] ** 2
        rest = value - terms[rows, nearest] - slope_rest * x
        # (rest + slope * x) * x - own = 0
        square = np.sqrt(np.maximum(rest * rest + 4 * slope_rest * own, 0))
        bottom = rest + np.where(rest >= 0, square, -square)
        one = 2 * own / np.where(bottom == 0, TINY, bottom)
        other = np.where(slope_rest > 0, -bottom / (2 * np.where(slope_rest > 0, slope_rest, 1)), one)
        guess = np.where((low < one) & (one < high), one, other)
        inside = (low < guess) & (guess < high)
        following = np.where(inside, guess, (low + high) / 2)
        done = exact | (np.abs(following - x) <= 2 * EPS * np.abs(following))
        x = np.where(exact, x, following)
        if done.all():
            break
    return nearest, x


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, vector: np.ndarray,
             ) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``vectors @ diag(values) @ vectors.T + rho * outer(vector, vector)``.

    ``values`` rise; ``rho`` is not negative. Eigenpairs whose direction the vector does not
    touch stay as they are, and of equal eigenvalues one takes the whole change (deflation). The
    others' vectors are made from weights recomputed for the roots found, which keeps them
    orthogonal.
    """
    z = vectors.T @ vector
    length = np.linalg.norm(z)
    if rho <= 0 or length == 0:
        return values, vectors
    rho, z = rho * length * length, z / length
    tolerance = 8 * EPS * max(np.abs(values).max(), rho)
    # Equal eigenvalues: turn their vectors so that one of them alone meets the update.
    breaks = np.flatnonzero(np.diff(values) > tolerance) + 1
    for group in np.split(np.arange(len(values)), breaks):
        if len(group) > 1:
            part = z[group]
            norm = np.linalg.norm(part)
            if norm == 0:
                continue
            mirror = part.copy()
            mirror[-1] += norm if part[-1] >= 0 else -norm
            mirror /= np.linalg.norm(mirror)
            if vectors.base is not None or not vectors.flags.writeable:
                vectors = vectors.copy()
            block = vectors[:, group]
            vectors[:, group] = block - 2 * np.outer(block @ mirror, mirror)
            z[group] = 0
            z[group[-1]] = -norm if part[-1] >= 0 else norm
    active = np.flatnonzero(rho * np.abs(z) > tolerance)
    if not len(active):
        return values, vectors
    poles, part = values[active], z[active]
    weights = rho * part * part
    nearest, x = secular_roots(poles, weights)
    # away[i, j]: pole j minus root i
    away = (poles - poles[nearest][:, None]) - x[:, None]
    n = len(active)
    # Weights for which the roots are exact.
    ratio = np.abs(away)
    between = np.abs(poles[:, None] - poles)
    np.fill_diagonal(between, 1.0)
    logs = np.log(ratio).sum(0) - np.log(between).sum(0)
    exact = np.where(part >= 0, 1.0, -1.0) * np.exp(logs / 2)
    turn = exact[:, None] / away.T
    turn /= np.linalg.norm(turn, axis=0)
    out_values, out_vectors = values.copy(), vectors.copy()
    out_values[active] = poles[nearest] + x
    out_vectors[:, active] = vectors[:, active] @ turn if n > 1 else vectors[:, active]
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, and the spectrum of the centred scatter of some vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width, np.int64), np.zeros(width), np.eye(width))

    def _shift(self, n: int, sums: np.ndarray) -> None:
        """Count and sums of more vectors; their means' distance is one more update."""
        if self.n:
            apart = sums / n - self.sums / self.n
            self.values, self.vectors = rank_one(
                self.values, self.vectors, self.n * n / (self.n + n), apart)
        self.n, self.sums = self.n + n, self.sums + sums

    def add(self, rows: np.ndarray) -> None:
        """Whole-number vectors, all centred on their own mean.

        More rows than dimensions are first rotated into as many as there are dimensions, which
        leaves their scatter as it is.
        """
        n, sums = len(rows), rows.sum(0)
        centred = (n * rows - sums) / n
        if n > rows.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        for vector in centred:
            self.values, self.vectors = rank_one(self.values, self.vectors, 1.0, vector)
        self._shift(n, sums)

    def combine(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.values, self.vectors = rank_one(self.values, self.vectors, value, vector)
        self._shift(other.n, other.sums)


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Vectors less the offset; short ones are filled up with entries of zero."""
    column = batch.column("x")
    sizes = np.array(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False) - OFFSET
    return out


def _batch(key: int, s: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([key], pa.int64()), pa.array([s.n], pa.int64()),
        pa.array([s.sums.tolist()], pa.list_(pa.int64())),
        pa.array([s.values.tolist()], pa.list_(pa.float64())),
        pa.array([s.vectors.ravel().tolist()], pa.list_(pa.float64())),
    ], [f.split()[0] for f in SPECTRUM.split(", ")])


def _read(row: dict, width: int) -> Spectrum:
    return Spectrum(row["n"], np.array(row["sums"], np.int64), np.array(row["values"]),
                    np.array(row["vectors"]).reshape(width, width))


def _spectrum_of(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = Spectrum.empty(width)
        for batch in batches:
            rows = _rows(batch, width)
            for low in range(0, len(rows), BATCH):
                held.add(rows[low:low + BATCH])
        if held.n:
            yield _batch(TaskContext.get().partitionId(), held)
    return run


def _combined(width: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        out, rows = Spectrum.empty(width), sorted(table.to_pylist(), key=lambda r: r["id"])
        for row in rows:
            out.combine(_read(row, width))
        return pa.Table.from_batches([_batch(rows[0]["id"] // FAN, out)])
    return run


def spectrum(fit: DataFrame, width: int) -> Spectrum | None:
    """The spectrum of the stored vectors ``x``; None without any.

    Only the last one, of a size set by the dimensions, comes to the driver.
    """
    current = durable(fit.mapInArrow(_spectrum_of(width), SPECTRUM), "spectra")
    while (n := current.count()) > 1:
        if n <= FAN:
            current = current.withColumn("id", F.lit(0).cast("long"))
        current = durable(
            current.groupBy((F.col("id") / FAN).cast("long")).applyInArrow(
                _combined(width), SPECTRUM), "spectra")
    row = current.first()
    return row and _read(row.asDict(), width)


def _projected(n: int, sums: np.ndarray, basis: np.ndarray) -> Callable:
    """Scatter of the centred rows in ``basis``, cell by cell, of a task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, wide = basis.shape
        total = np.zeros((wide, wide))
        for batch in batches:
            y = ((n * _rows(batch, width) - sums) / n) @ basis
            total += y.T @ y
        i, j = np.triu_indices(wide)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])
    return run


def ritz(fit: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance, over all stored vectors, of their projections on the columns of ``basis``."""
    cells = fit.mapInArrow(_projected(n, sums, basis), "i int, j int, v double").groupBy(
        "i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((basis.shape[1],) * 2)
    for i, j, v in cells:
        out[i, j] = out[j, i] = v / n
    return out


def _whitened(columns: list[str], n: int, sums: np.ndarray, basis: np.ndarray, values: np.ndarray,
              ) -> Callable:
    """Deviation and the whitened components of every row, a row for each component."""
    width, wide = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = n * _rows(batch, width) - sums
            about = (apart.astype(float) ** 2).sum(1)
            deviation = pa.array((apart * apart).sum(1), mask=about >= 2.0**63)
            white = ((apart / n) @ basis) / np.sqrt(values)
            each = pa.array(np.repeat(np.arange(len(white)), wide))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(each) for c in columns],
                pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), len(white))),
                deviation.take(each), pa.array(white.ravel()),
            ], [*columns, "component", "deviation", "whitened"])
    return run


def whole_entries(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * scale) + F.lit(OFFSET))


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16,
    scale: int = 64,
) -> DataFrame:
    """Whitened components of every row with a whole vector, up to ``most`` a row.

    An entry c counts as x = floor(``scale`` * c) + 1,000,000. The covariance is that of the
    distinct vectors x, each once. Returns ``id_col, component`` (from 1, by falling eigenvalue),
    ``n`` (distinct vectors), ``deviation`` (exact; null beyond 64 bits), ``whitened``,
    ``explained`` (the component's share of the variance) and ``identity_error`` (the largest
    entry of the whitened covariance minus the identity, measured over all distinct vectors).

    Rows whose vector is null or has null or non-finite entries are left out; ids may be null
    or repeat, each row has its own result. Vectors of other lengths are filled up with
    entries of zero. Directions without variance have no component; an empty table, or one of
    equal vectors, gives no rows. Other columns, whatever their names, are left alone.
    """
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(vector.isNotNull() & ~bad).select(
        F.col(id_col).alias("__id"), whole_entries(vector, scale).alias("x"))
    schema = T.StructType([
        vectors.schema[id_col], T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType())])
    nothing = vectors.sparkSession.createDataFrame([], schema)
    fit = durable(rows.select("x").distinct(), "distinct")
    width = fit.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return nothing
    found = spectrum(fit, width)
    n, sums = found.n, found.sums
    frame = np.linalg.qr(found.vectors)[0]
    values, turn = np.linalg.eigh(ritz(fit, n, sums, frame))
    falling = np.argsort(-values, kind="stable")
    trace = values.sum()
    falling = falling[values[falling] > 64 * width * EPS * trace][:most]
    if not len(falling):
        return nothing
    values, basis = values[falling], frame @ turn[:, falling]
    basis /= np.linalg.norm(basis, axis=0)
    checked = ritz(fit, n, sums, basis) / np.sqrt(np.outer(values, values))
    error = float(np.abs(checked - np.eye(len(values))).max())
    shares = F.element_at(F.array(*[F.lit(float(v / trace)) for v in values]), F.col("component"))
    out = rows.mapInArrow(
        _whitened(["__id"], n, sums, basis, values),
        T.StructType([T.StructField("__id", vectors.schema[id_col].dataType),
                      T.StructField("component", T.IntegerType()),
                      T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType())]))
    return out.select(
        F.col("__id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))
