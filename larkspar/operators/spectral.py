"""Spectral orders: rows by the second eigenvector of the Laplacian of their similarities, never formed as a whole.

For single vectors the similarity is a cosine plus one, of low rank: L = D - B B' with B = [X, 1].  By Sylvester's law L has as many
eigenvalues below t as D has entries below t, and the small matrix G(t) = B' (D - t)^-1 B eigenvalues above 1.  Tasks sum G at
several t in one pass; the second eigenvalue is enclosed, and its eigenvector is (D - t)^-1 B y, row by row.

For centroids the similarity is clipped at zero, which has no low rank.  Lanczos steps multiply by blocks; vectors with an
entry for each row are columns of tables, and only products of two of them, numbers, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspar.operators.order import numbered
from larkspar.storage import Scratch, stored

#: Values of t that a pass is made for, and passes at most; places to which entries are compared, so that equal rows are ties.
AT_ONCE, PASSES, PLACES = 24, 40, 9
#: Rows of a block of centroids; Lanczos steps at most, and the residual (beside the norm) at which they end.
BLOCK, STEPS, RESIDUAL = 1_024, 300, 1e-12


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of an array that ``part`` makes of each; its size is one of the vectors', not of the rows'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = part(batch)
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "x"])

    found = rows.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    return found.sort_values("i")["x"].to_numpy()


def second_eigenvalue(rows: DataFrame, sums: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """(t, y) of rows (v): the second eigenvalue t, and the eigenvector of G(t) for the eigenvalue nearest 1."""
    d = len(sums)

    def weighed(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
        x = matrix(batch.column(0))
        b, diagonal = np.column_stack((x, np.ones(len(x)))), x @ sums + n
        apart = diagonal[None, :] - at[:, None]
        apart[apart == 0] = 1e-300
        return np.concatenate([((b / a[:, None]).T @ b).ravel() for a in apart] + [(apart < 0).sum(1).astype(float)])

    two = rows.select((F.aggregate(F.zip_with("v", F.array(*map(F.lit, sums.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c) + n).alias("d")).orderBy("d").limit(2).toPandas()["d"].to_numpy()
    low, high = 0.0, float(two[-1])
    for _ in range(PASSES):
        inner = np.linspace(low, high, AT_ONCE + 2)[1:-1]
        got = summed(rows.select("v"), lambda batch, at=inner: weighed(batch, at))
        grams = got[: AT_ONCE * (d + 1) ** 2].reshape(AT_ONCE, d + 1, d + 1)
        below = got[-AT_ONCE:] + np.array([(np.linalg.eigvalsh(g) > 1).sum() for g in grams])  # eigenvalues below each t
        k = int(np.searchsorted(below >= 2, True))  # the first t that two eigenvalues are below
        edges = np.concatenate(([low], inner, [high]))
        width, low, high = high - low, edges[k], edges[k + 1]
        if high - low <= 4e-16 * high or high - low >= width:
            break
    t = (low + high) / 2
    gram = summed(rows.select("v"), lambda batch: weighed(batch, np.array([t])))[: (d + 1) ** 2].reshape(d + 1, d + 1)
    values, vectors = np.linalg.eigh(gram)
    return t, vectors[:, np.abs(values - 1).argmin()]


def image_order(vectors: DataFrame) -> DataFrame:
    """vectors (key, v), of unit length, in the order of their similarities' second eigenvector: key, place (from 1).

    The sign is such that the entry of the smallest key is not positive; entries that agree to PLACES of the largest are ties by
    key.  Up to two vectors are in the order of keys.
    """
    rows = stored(vectors.select("key", "v"), "vectors")
    n = rows.count()
    if n < 3:
        return numbered(rows.select("key"), "place", "key")
    sums = summed(rows.select("v"), lambda batch: matrix(batch.column(0)).sum(0))
    t, y = second_eigenvalue(rows, sums, n)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array((x @ y[:-1] + y[-1]) / (x @ sums + n - t))], ["key", "entry"])

    found = stored(rows.mapInArrow(entries, "key long, entry double"), "entries")
    return placed(found)


def placed(found: DataFrame) -> DataFrame:
    """Places (from 1) of keys by their entries (key, entry)."""
    size, first = found.agg(F.max(F.abs("entry")), F.min_by("entry", "key")).first()
    even = F.round(F.col("entry") * (-1.0 if first > 0 else 1.0) / (size or 1.0), PLACES)
    return numbered(found.select("key", even.alias("entry")), "place", "entry", "key").select("key", "place")


def multiplied(rows: DataFrame, blocks: int) -> DataFrame:
    """rows (place, v, q): per place y, the sum of all others' q, each times the similarity to it, clipped at zero, and degree, that of the similarities."""

    def products(t: pd.DataFrame) -> pd.DataFrame:
        x, q, block = np.stack(t["v"].to_numpy()), t["q"].to_numpy(), t["block"].to_numpy()
        w = np.clip(x @ x.T, 0, None)
        np.fill_diagonal(w, 0)
        if t["bi"][0] != t["bj"][0]:
            w[block[:, None] == block[None, :]] = 0
        return pd.DataFrame({"place": t["place"], "y": w @ q, "degree": w.sum(1)})

    own = F.pmod("place", F.lit(blocks)).cast("int")
    met = rows.select("place", "v", "q", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    met = met.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other")
    return met.groupBy("bi", "bj").applyInPandas(products, "place long, y double, degree double").groupBy("place").agg(F.sum("y").alias("y"), F.sum("degree").alias("degree"))


def clipped_order(rows: DataFrame) -> DataFrame:
    """rows (key, v), of unit length, in the order of the second eigenvector of their clipped similarities: key, place.

    Lanczos steps from a vector orthogonal to the constant one, each result made orthogonal to all before it, twice.
    """
    with Scratch(rows.sparkSession) as scratch:
        keyed = scratch.stored(numbered(rows.select("key", "v"), "place", "key").withColumn("place", F.col("place").cast("long")), "rows")
        n = keyed.count()
        blocks = max(1, -(-n // BLOCK))
        start = F.sin(F.col("place").cast("double") * 1.7 + 0.3)
        mean = keyed.agg(F.avg(start)).first()[0]
        state = keyed.select("place", "v", F.array(F.lit(1 / np.sqrt(n))).alias("basis"), (start - mean).alias("w"))
        norm = np.sqrt(state.agg(F.sum(F.col("w") * F.col("w"))).first()[0])
        state = scratch.stored(state.select("place", "v", "basis", (F.col("w") / norm).alias("q")), "state")
        alphas, betas, scale = [], [], 0.0
        while True:
            y = multiplied(state.select("place", "v", "q"), blocks)
            step = state.join(y, "place").select("place", "v", F.concat("basis", F.array("q")).alias("basis"), (F.col("degree") * F.col("q") - F.col("y")).alias("w"), "degree")
            step = scratch.stored(step, "step")
            along = lambda batch: matrix(batch.column(0)).T @ batch.column(1).to_numpy()
            first = summed(step.select("basis", "w"), along)
            less = lambda h: F.col("w") - F.aggregate(F.zip_with("basis", F.array(*map(F.lit, h.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)
            once = scratch.stored(step.select("place", "v", "basis", less(first).alias("w")), "once")
            second = summed(once.select("basis", "w"), along)
            left = scratch.stored(once.select("place", "v", "basis", less(second).alias("w")), "left")
            alphas.append(float(first[-1]))
            beta = float(np.sqrt(left.agg(F.sum(F.col("w") * F.col("w"))).first()[0]))
            t = np.diag(alphas) + np.diag(betas, 1) + np.diag(betas, -1)
            values, vectors = np.linalg.eigh(t)
            scale = max(scale, float(np.abs(values).max()), 1e-300)
            if abs(beta * vectors[-1, 0]) <= RESIDUAL * scale or beta <= 1e-13 * scale or len(alphas) >= min(n - 1, STEPS):
                weights = np.concatenate(([0.0], vectors[:, 0]))
                entry = F.aggregate(F.zip_with("basis", F.array(*map(F.lit, weights.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)
                return placed(stored(left.select("place", entry.alias("entry")).join(keyed.select("place", "key"), "place").select("key", "entry"), "entries"))
            betas.append(beta)
            for table in (state, step, once):
                scratch.drop(table)
            state = scratch.stored(left.select("place", "v", "basis", (F.col("w") / beta).alias("q")), "state")
            scratch.drop(left)
