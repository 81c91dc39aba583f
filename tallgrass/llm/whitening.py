"""Whitening of embeddings by incremental eigendecomposition.

Each partition keeps the spectrum of what it has seen (count, mean, eigenvalues and eigenvectors of the scatter) and
moves it by one centred rank-one update a vector: the secular equation gives the new eigenvalues, after deflation of
directions that the update does not touch. Spectra of partitions are combined in rounds, again by rank-one updates: one
for each eigenvector of the smaller side and one for the distance of the means. The basis that comes out is refined once
by Rayleigh-Ritz over all vectors, where the projected covariance is summed by the partitions.

A partition's state is a square matrix of the dimension, whatever the number of rows. Sums of the entries are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Entries beyond this are held at it, so that every later sum is defined.
LARGEST = 2.0**52
#: Spectra that one task combines.
FAN_IN = 16
EPS = np.finfo(float).eps
LONGEST = 2**63 - 1


# ------------------------------------------------------------------------------------------------- rank-one updates


def secular_roots(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z^2 / (poles - x)), one right of each ascending pole, for rho > 0 and z without zeros.

    A root is origin + offset, the origin the nearer pole, so that its distance from either pole keeps its digits.
    Returned are the roots and the matrix of poles[j] - root[i]. All roots are sought at once, by rational steps inside
    a shrinking bracket.
    """
    k = len(poles)
    squares = rho * z * z
    upper = np.append(poles[1:], poles[-1] + squares.sum())
    gap = upper - poles
    middle = 1 + (squares / (poles[None, :] - (poles + gap / 2)[:, None])).sum(axis=1)
    right = middle < 0
    right[-1] = False
    origin = np.arange(k) + right
    shifted = poles[None, :] - poles[origin][:, None]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(np.arange(k) == k - 1, gap, gap / 2))
    high[-1] *= 1 + 4 * EPS
    at = (low + high) / 2
    rows = np.arange(k)
    left_of = rows[None, :] <= rows[:, None]
    # Two weights a pole, for the poles up to the root's own and for those beyond it.
    left, beyond = np.where(left_of, squares, 0.0), np.where(left_of, 0.0, squares)
    pole, following = shifted[rows, rows], shifted[rows, np.minimum(rows + 1, k - 1)]
    for _ in range(80):
        inverse = 1 / (shifted - at[:, None])
        lefts, beyonds = left * inverse, beyond * inverse
        psi, phi = lefts.sum(axis=1), beyonds.sum(axis=1)
        value = 1 + psi + phi
        low, high = np.where(value < 0, at, low), np.where(value > 0, at, high)
        done = np.abs(value) <= EPS * k * (1 - psi + phi)
        done |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        dpsi, dphi = np.vecdot(lefts, inverse), np.vecdot(beyonds, inverse)
        near, far = pole - at, following - at
        # Both halves of the sum are replaced by one pole each, with the same value and slope at this point.
        constant = value - near * dpsi - far * dphi
        linear = (near + far) * value - near * far * (dpsi + dphi)
        product = near * far * value
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.sqrt(np.maximum(linear * linear - 4 * product * constant, 0))
            step = np.where(linear <= 0, (linear - spread) / (2 * constant), 2 * product / (linear + spread))
            step[-1] = near[-1] + near[-1] ** 2 * dpsi[-1] / (value[-1] - near[-1] * dpsi[-1])  # no pole beyond it
            trial = at + step
        inside = (trial > low) & (trial < high)
        at = np.where(done, at, np.where(inside, trial, (low + high) / 2))
    return poles[origin] + at, shifted - at[:, None]


@dataclass
class Spectrum:
    """Count, mean and eigendecomposition of the scatter (sum of squared deviations) of some vectors."""

    dim: int
    count: int = 0
    mean: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)
    vectors: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.mean is None:
            self.mean, self.values, self.vectors = np.zeros(self.dim), np.zeros(self.dim), np.eye(self.dim)

    def add(self, x: np.ndarray) -> None:
        """One more vector."""
        away = x - self.mean
        self.count += 1
        self.mean = self.mean + away / self.count
        if self.count > 1:
            self.update(away, (self.count - 1) / self.count)

    def merge(self, other: Spectrum) -> None:
        """All vectors of another spectrum."""
        if not other.count:
            return
        if not self.count:
            self.count, self.mean, self.values, self.vectors = other.count, other.mean, other.values, other.vectors
            return
        away = other.mean - self.mean
        total = self.count + other.count
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(vector, value)
        self.update(away, self.count * (other.count / total))
        self.mean = self.mean + away * (other.count / total)
        self.count = total

    def update(self, x: np.ndarray, rho: float) -> None:
        """The eigendecomposition of scatter + rho * x x', values ascending."""
        z = self.vectors.T @ x
        size = float(z @ z)
        if not rho * size > 0:
            return
        tolerance = 8 * EPS * max(float(np.abs(self.values).max()), rho * size)
        self._turn_equal_values(z, tolerance)
        live = np.flatnonzero(rho * np.abs(z) * np.sqrt(size) > tolerance)
        if not len(live):
            return
        poles = self.values[live]
        roots, distance = secular_roots(poles, z[live], rho)
        # The vector for which these roots are exact keeps the eigenvectors orthogonal (distance[i, j] = poles[j] - root i).
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = -distance / np.where(np.eye(len(live), dtype=bool), 1.0, poles[:, None] - poles[None, :])
        exact = np.sqrt(np.abs(ratio.prod(axis=0))) * np.where(z[live] < 0, -1.0, 1.0)
        weights = exact[None, :] / distance
        weights /= np.sqrt((weights * weights).sum(axis=1, keepdims=True))
        values, vectors = self.values.copy(), self.vectors.copy()
        values[live] = roots
        vectors[:, live] = self.vectors[:, live] @ weights.T
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = np.maximum(values[order], 0), vectors[:, order]

    def _turn_equal_values(self, z: np.ndarray, tolerance: float) -> None:
        """Inside each group of equal eigenvalues, turn the basis so that one vector carries all of z."""
        values, start = self.values, 0
        close = np.diff(values) <= tolerance
        if not close.any():
            return
        vectors = self.vectors.copy()
        while start < len(values):
            end = start + 1
            while end < len(values) and close[end - 1] and values[end] - values[start] <= tolerance:
                end += 1
            if end - start > 1 and np.abs(z[start : end - 1]).max() > 0:
                part = z[start:end].copy()
                length = np.sqrt(part @ part)
                mirror = part.copy()
                mirror[-1] += length if part[-1] >= 0 else -length
                mirror /= np.sqrt(mirror @ mirror)
                group = vectors[:, start:end]
                vectors[:, start:end] = group - 2 * np.outer(group @ mirror, mirror)
                z[start:end] = 0
                z[end - 1] = -length if part[-1] >= 0 else length
            start = end
        self.vectors = vectors


# ---------------------------------------------------------------------------------------------------------- the table


def usable(vector: Column) -> Column:
    """True where a vector and its entries are neither null nor non-finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def whole_numbers(vector: Column) -> Column:
    """Entries as floor(64 * c) + 1000000, held within 2^52 of it."""

    def entry(c: Column) -> Column:
        scaled = F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))
        return F.floor(scaled).cast("long") + F.lit(OFFSET).cast("long")

    return F.transform(vector, entry)


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


STATE_SCHEMA = "part int, n long, sums array<string>, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"
STATE_ARROW = pa.schema(
    [("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]
    + [(c, pa.list_(pa.float64())) for c in ("mean", "eigenvalues", "eigenvectors")]
)


def _state_row(part: int, spectrum: Spectrum, sums: list[int]) -> dict:
    return {
        "part": part, "n": spectrum.count, "sums": [str(s) for s in sums], "mean": spectrum.mean.tolist(),
        "eigenvalues": spectrum.values.tolist(), "eigenvectors": spectrum.vectors.ravel().tolist(),
    }


def _column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of whole numbers, each half of the bits apart so that none wraps."""
    high, low = x >> 26, x & (2**26 - 1)
    return [(int(h) << 26) + int(w) for h, w in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def _spectra(dim: int):
    """One spectrum a partition, of batches (part, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums, part = Spectrum(dim), [0] * dim, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            x = matrix_of(batch.column(1), dim)
            sums = [a + b for a, b in zip(sums, _column_sums(x), strict=True)]
            for row in (x - OFFSET).astype(float):
                spectrum.add(row)
        if spectrum.count:
            yield pa.RecordBatch.from_pylist([_state_row(part, spectrum, sums)], schema=STATE_ARROW)

    return run


def _combined(dim: int):
    """The states of a group as one, in the order of their parts."""

    def run(states: pa.Table) -> pa.Table:
        spectrum, sums, rows = Spectrum(dim), [0] * dim, states.sort_by("part").to_pylist()
        for row in rows:
            spectrum.merge(_spectrum_of(row, dim))
            sums = [a + int(b) for a, b in zip(sums, row["sums"], strict=True)]
        return pa.Table.from_pylist([_state_row(rows[0]["part"], spectrum, sums)], schema=STATE_ARROW)

    return run


def _spectrum_of(row: dict, dim: int) -> Spectrum:
    vectors = np.array(row["eigenvectors"]).reshape(dim, dim)
    return Spectrum(dim, row["n"], np.array(row["mean"]), np.array(row["eigenvalues"]), vectors)


@dataclass
class Whitening:
    """What a fit gives: n vectors with exact sums, and components by falling eigenvalue."""

    count: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: whole parts subtracted as whole numbers first."""
        whole = np.array([s // self.count for s in self.sums])
        rest = np.array([(s % self.count) / self.count for s in self.sums])
        return (x - whole).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums)^2, exact; null where it exceeds a long."""
        n = self.count
        whole = np.array([s // n for s in self.sums])
        rest = [s % n for s in self.sums]
        near = x - whole
        bound = n * (int(np.abs(near).max(initial=0)) + 1)
        if x.shape[1] * bound * bound <= LONGEST:
            apart = n * near - np.array(rest)
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in near]
        return [e if e <= LONGEST else None for e in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def spectrum(distinct: DataFrame, dim: int, parts: int, fan_in: int = FAN_IN) -> tuple[Spectrum, list[int]]:
    """The spectrum of all rows of distinct (x array<long>), and the exact sums of their entries."""
    dealt = distinct.repartition(parts).select(F.spark_partition_id().alias("part"), "x")
    states = common.stored(dealt.mapInArrow(_spectra(dim), STATE_SCHEMA))
    while parts > 1:
        parts = -(-parts // fan_in)
        group = F.floor(F.col("part") / fan_in).cast("int")
        merged = states.groupBy(group.alias("group")).applyInArrow(_combined(dim), STATE_SCHEMA)
        states = common.stored(merged.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")))
    row = states.first().asDict()
    return _spectrum_of(row, dim), [int(s) for s in row["sums"]]


def _moments(project):
    """Count, mean and scatter of a partition's projected vectors, one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, scatter = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                y = project(batch.column(0))
                own = y.mean(axis=0)
                away, total = own - mean, count + len(y)
                scatter = scatter + (y - own).T @ (y - own) + np.outer(away, away) * (count * (len(y) / total))
                mean, count = mean + away * (len(y) / total), total
        if count:
            yield pa.RecordBatch.from_pylist(
                [{"n": count, "mean": mean.tolist(), "scatter": scatter.ravel().tolist()}], schema=MOMENT_ARROW
            )

    return run


MOMENT_SCHEMA = "n long, mean array<double>, scatter array<double>"
MOMENT_ARROW = pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64()))])


def projected_covariance(distinct: DataFrame, model: Whitening, basis: np.ndarray, parts: int) -> np.ndarray:
    """Covariance of the centred vectors in a basis: partitions sum outer products, Spark adds them up entry by entry.

    What reaches the driver is one matrix. Means of the projected vectors are taken off as well, exact or not.
    """
    size = basis.shape[1]

    def project(column: pa.Array) -> np.ndarray:
        return model.centred(matrix_of(column, len(model.sums))) @ basis

    moments = distinct.repartition(parts).mapInArrow(_moments(project), MOMENT_SCHEMA)
    # Centres are the same for all partitions but for rounding, so the scatter about zero adds up as it is.
    about_zero = moments.select(
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(size * size - 1)),
                lambda k: F.get("scatter", k)
                + F.col("n") * F.get("mean", F.floor(k / size).cast("int")) * F.get("mean", k % size),
            )
        ).alias("cell", "value")
    )
    summed = about_zero.groupBy("cell").agg(F.sum("value").alias("value")).collect()
    matrix = np.zeros(size * size)
    for cell, value in summed:
        matrix[cell] = value
    matrix = matrix.reshape(size, size) / model.count
    return (matrix + matrix.T) / 2


def fit(distinct: DataFrame, components: int = COMPONENTS, parts: int | None = None) -> Whitening | None:
    """The whitening of distinct (x array<long>), vectors of one length, each once; None without vectors.

    Components with an eigenvalue of zero (to rounding) cannot be whitened and are left out.
    """
    parts = parts or common.partitions(distinct.sparkSession)
    first = distinct.first()
    dim = len(first[0]) if first else 0
    if not dim:
        return None
    rough, sums = spectrum(distinct, dim, parts)
    basis = np.linalg.qr(rough.vectors[:, ::-1])[0]
    model = Whitening(rough.count, sums, np.zeros(0), basis, 0.0)
    values, turn = np.linalg.eigh(projected_covariance(distinct, model, basis, parts))
    values, vectors = values[::-1], basis @ turn[:, ::-1]
    model.trace = float(values.sum())
    kept = min(components, int((values > dim * EPS * max(values[0], 0) * 64).sum()) if values[0] > 0 else 0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dim)])
    model.values, model.vectors = values[:kept], (vectors * signs)[:, :kept]
    if kept:
        covariance = projected_covariance(distinct, model, model.vectors / np.sqrt(model.values), parts)
        model.identity_error = float(np.abs(covariance - np.eye(kept)).max())
    return model


OUTPUT_SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows (vec_id, x) with one row for each component."""
    kept = len(model.values)

    def whiten(batch: pa.RecordBatch) -> dict:
        x = matrix_of(batch.column(1), len(model.sums))
        size = len(x)
        return {
            "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(size), kept))),
            "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), size),
            "n": np.full(size * kept, model.count),
            "deviation": pa.array([d for d in model.deviations(x) for _ in range(kept)], pa.int64()),
            "whitened": model.whitened(x).ravel(),
            "explained": np.tile(model.values / model.trace, size),
            "identity_error": np.full(size * kept, model.identity_error),
        }

    return common.map_rows(rows, OUTPUT_SCHEMA, whiten)


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened rows of table (vec_id, embedding array of numbers), other columns ignored.

    Rows whose vector is null or holds null or non-finite entries are left out. Vectors of several lengths cannot share a
    covariance: the most frequent length (of equals the larger) is fitted and returned. Repeated rows come back each, and
    count once in the fit. A null vec_id stays. No usable vectors, or only equal ones, give no rows.
    """
    rows = table.where(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("x")
    )
    distinct = common.stored(rows.select("x").distinct())
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    same = F.size("x") == (lengths["dim"] if lengths else 0)
    model = fit(distinct.where(same), components)
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], OUTPUT_SCHEMA)
    return apply(rows.where(same), model)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on up to sixteen components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
