"""Whitening of vectors by an incremental eigendecomposition.

1. Each task takes its vectors one by one.  A vector changes the scatter matrix by a multiple of the outer product of its
   deviation from the mean so far; the spectrum follows by a rank-one update: the secular equation gives the
   new eigenvalues, and these the eigenvectors.  Components that an update leaves alone, and equal eigenvalues, are
   deflated first.
2. Spectra of two sets of vectors are combined by further rank-one updates, one for each eigenvector of the second and
   one for the distance of the means.  FAN of them meet in a task, in rounds, until one is left.
3. The basis that was found is refined by a Rayleigh-Ritz step: tasks sum the outer products of the centred vectors in
   that basis, and the small matrix is decomposed.
4. Vectors are projected on the components; the covariance of the result is summed once more and held against identity.

Entries become integers (``floor(scale * c) + offset``), so that sums and deviations are exact.  Nothing but states of the size
of a matrix leaves a task.  Rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do
rows with another number of entries than most have (of equally frequent lengths, the largest is kept).  Null and repeated ids are
rows of their own.  Components without variance (below 10^-13 of the largest) have no unit scale and are not returned, so
a single row, or equal rows only, have an empty result, as has an empty table.  A deviation beyond a long is null.  Other
columns, whatever their names, are ignored.  The input is read once for each step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm.common import Scratch, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Spectra that meet in one task, steps of the search for roots, and what counts as nothing beside the largest value.
FAN, STEPS, NOTHING = 8, 60, 1e-15
VANISHING = 1e-13

STATE = "part long, n long, sums array<long>, mean array<double>, values array<double>, vectors array<double>"


def secular_roots(poles: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Differences pole - root, a row for each root, of 1 + sum of squares / (poles - root) = 0; poles ascend and differ.

    Each root is sought from the nearer of its two poles, so that the differences are exact to the last bits: by an
    interpolation with both poles, and by halving where that leads out of the bracket.
    """
    n, total = len(poles), squares.sum()
    upper = np.append(poles[1:], poles[-1] + total)
    gap = upper - poles
    k = np.arange(n)
    below = k[None, :] <= k[:, None]
    middle = poles[None, :] - poles[:, None] - gap[:, None] / 2
    at_middle = 1 + (squares[None, :] / middle).sum(1)
    near_upper = (at_middle < 0) & (k < n - 1)  # the root is in the upper half
    origin = np.where(near_upper, k + 1, k)
    apart = poles[None, :] - poles[origin][:, None]
    low, high = np.where(near_upper, -gap / 2, 0.0), np.where(near_upper, 0.0, gap / 2)
    last = n - 1
    low[last], high[last] = (gap[last] / 2, gap[last]) if at_middle[last] < 0 else (0.0, gap[last] / 2)
    x = (low + high) / 2
    left, right = apart[k, k], np.append(apart[k[:-1], k[:-1] + 1], gap[last])
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            delta = apart - x[:, None]
            term = squares[None, :] / delta
            slope = term / delta
            f = 1 + term.sum(1)
            done = (np.abs(f) <= 4 * np.finfo(float).eps * (1 + np.abs(term).sum(1))) | (high - low <= 2 * np.finfo(float).eps * np.abs(x))
            if done.all():
                break
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            psi = np.where(below, slope, 0).sum(1)
            phi = slope.sum(1) - psi
            a0, a1 = left - x, right - x
            a = (a0 + a1) * f - a0 * a1 * (psi + phi)
            b = a0 * a1 * f
            c = f - a0 * psi - a1 * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            x = np.where(done, x, new)
    return apart - x[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of vectors @ diag(values) @ vectors.T + outer(change, change); values ascend."""
    z = vectors.T @ change
    size = max(abs(values[-1]), abs(values[0]), float(z @ z))
    if not size:
        return values, vectors
    # Equal eigenvalues: their vectors are reflected so that one of them takes the whole change.
    ends = np.flatnonzero(np.append(np.diff(values) > NOTHING * size, True))
    if len(ends) < len(values):
        vectors = vectors.copy()
        for first, last in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
            if last > first and (norm := np.linalg.norm(part := z[first : last + 1].copy())):
                part[-1] += np.copysign(norm, part[-1])
                block = vectors[:, first : last + 1]
                block -= np.outer(block @ part, part) * (2 / (part @ part))
                z[first : last + 1] = vectors[:, first : last + 1].T @ change
                z[first:last] = 0
    # Components that the change does not reach stay as they are.
    moved = np.flatnonzero(np.abs(z) * np.sqrt(size) > NOTHING * size)
    if not len(moved):
        return values, vectors
    poles = values[moved]
    delta = secular_roots(poles, z[moved] ** 2)
    # The change for which these roots are exact: with it the eigenvectors are orthogonal to the last bits.
    n = len(poles)
    apart = poles[:, None] - poles[None, :]  # apart[k, j] = pole k - pole j
    k = np.arange(n)
    below = np.where(k[:, None] < k[None, :], apart, np.vstack((apart[1:], np.ones(n))))  # the last row belongs to no pole
    exact = np.sqrt(np.abs(np.prod(np.abs(delta) / np.abs(below), axis=0)))
    turn = np.copysign(exact, z[moved])[:, None] / delta.T
    turn /= np.linalg.norm(turn, axis=0)
    found = values.copy()
    found[moved] = poles + (-delta[k, k])
    out = vectors.copy()
    out[:, moved] = vectors[:, moved] @ turn
    order = np.argsort(found, kind="stable")
    return found[order], out[:, order]


@dataclass
class Spectrum:
    """Of some vectors: their number, exact sums, mean, and the scatter matrix by eigenvalues (ascending) and eigenvectors."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d, np.int64), np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray) -> None:
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, (x - self.mean) * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.sums += x
        self.mean = self.sums / self.n

    def combine(self, other: Spectrum) -> None:
        if self.n and other.n:
            for value, vector in zip(other.values, other.vectors.T, strict=True):
                if value > 0:
                    self.values, self.vectors = rank_one(self.values, self.vectors, np.sqrt(value) * vector)
            self.values, self.vectors = rank_one(self.values, self.vectors, (other.mean - self.mean) * np.sqrt(self.n * other.n / (self.n + other.n)))
        elif other.n:
            self.values, self.vectors = other.values, other.vectors
        self.n, self.sums = self.n + other.n, self.sums + other.sums
        self.mean = self.sums / max(1, self.n)

    def batch(self, part: int) -> pa.RecordBatch:
        lists = [self.sums.tolist(), self.mean.tolist(), self.values.tolist(), self.vectors.ravel().tolist()]
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([self.n]), pa.array([lists[0]], pa.list_(pa.int64())), *(pa.array([x], pa.list_(pa.float64())) for x in lists[1:])], STATE.replace(",", "").split()[::2])

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        d = len(row["sums"])
        return cls(row["n"], np.array(row["sums"], np.int64), np.array(row["mean"]), np.array(row["values"]), np.array(row["vectors"]).reshape(d, d))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def integer_vectors(vectors: DataFrame, id_column: str, vector: str, scale: int, offset: int) -> tuple[DataFrame, int]:
    """The rows that take part (id, x), and the number of their entries (0: there are none)."""
    v = F.col(f"`{vector}`")
    sound = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    rows = vectors.filter(sound & (F.size(v) > 0)).select(F.col(f"`{id_column}`").cast("long").alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale) + offset).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.filter(F.size("x") == lengths["d"]), lengths["d"]) if lengths else (rows, 0)


def fitted(rows: DataFrame, d: int) -> Spectrum:
    """The spectrum of all rows (x)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum.empty(d)
        for batch in batches:
            for x in matrix(batch.column(0), d):
                found.add(x)
        if found.n:
            yield found.batch(TaskContext.get().partitionId())

    def together(t: pa.Table) -> pa.Table:
        states = sorted(t.to_pylist(), key=lambda r: r["part"])
        found = Spectrum.empty(d)
        for row in states:
            found.combine(Spectrum.of(row))
        return pa.Table.from_batches([found.batch(states[0]["part"] // FAN)])

    with Scratch(rows.sparkSession) as scratch:
        states = scratch.stored(rows.select("x").mapInArrow(each, STATE), "states")
        while states.count() > 1:
            before, states = states, scratch.stored(states.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(together, STATE), "combined")
            scratch.drop(before)
        return Spectrum.of(states.first().asDict())


def products(rows: DataFrame, mean: np.ndarray, basis: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (x - mean) @ basis * scale and of the outer products of these, added up over all tasks."""
    d, k = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = (matrix(batch.column(0), d) - mean) @ basis * scale
            first += y.sum(0)
            second += y.T @ y
        whole = np.append(first, second.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole))), pa.array(whole)], ["i", "v"])

    sums = rows.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
    return sums[:k], sums[k:].reshape(k, k)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Per row that takes part and component: id_column, component, n, deviation, whitened, explained, identity_error."""
    rows, d = integer_vectors(vectors, id_column, vector, scale, offset)
    result = f"`{id_column}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = vectors.sparkSession.createDataFrame([], result)
    if not d:
        return nothing
    found = fitted(rows, d)
    n, sums, mean = found.n, found.sums, found.sums / found.n
    basis, _ = np.linalg.qr(found.vectors)
    first, second = products(rows, mean, basis, np.ones(d))
    values, turn = np.linalg.eigh(second / n - np.outer(first, first) / n / n)
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(d)])
    some = int((values[:components] > max(VANISHING * values[0], 0)).sum())
    if not some:
        return nothing
    axes, unit = axes[:, :some], 1 / np.sqrt(values[:some])
    first, second = products(rows, mean, axes, unit)
    error = float(np.abs(second / n - np.outer(first, first) / n / n - np.eye(some)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), d)
            from_mean = n * x - sums  # a wrapped product is right modulo 2 ** 64, so that a sum within a long is exact
            rough = ((x - mean) ** 2).sum(1) * float(n) ** 2
            deviation = pa.array((from_mean * from_mean).sum(1), mask=rough > 9.2e18)
            y = ((x - mean) @ axes * unit).ravel()
            yield pa.RecordBatch.from_arrays([batch.column("id"), deviation, pa.FixedSizeListArray.from_arrays(pa.array(y), some).cast(pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    out = rows.select("id", "x").mapInArrow(run, "id long, deviation long, whitened array<double>").select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*map(F.lit, (values[:some] / values.sum()).tolist()))
    return out.select(F.col("id").alias(id_column), (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector and component up to 32: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(table(spark, sf_dir, "embeddings"))
