"""How a cluster's vectors lie around its centroid: density of the radius, a fit of its law, equal-size draws, and directions.

Clusters may be of any size: tasks sum kernels, logarithms and counts; ranks are given by ranges (``layout.radii``).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.functions.vectors import dot
from larkspar.operators.layout import profile, radii
from larkspar.operators.order import numbered
from larkspar.storage import stored

# Points of the grid, a peak's least prominence beside the highest density, and the level of the test.
GRID, PROMINENCE, LEVEL = 400, 0.15, 0.05
#: Rows of the bucket in which a draw's threshold lies, about.
BUCKET = 1_000


def trigamma_step(a: float, target: float) -> float:
    """One Newton step for log(a) - digamma(a) = target, in the logarithm of a."""
    x, psi, tri = a, 0.0, 0.0
    while x < 12:
        psi -= 1 / x
        tri += 1 / x**2
        x += 1
    psi += np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    tri += 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7) - 1 / (30 * x**9)
    slope = 1 - a * tri  # of the difference, by log(a): negative
    return a * np.exp(np.clip((target - (np.log(a) - psi)) / slope, -2, 2))


def chi_fit(mean_square: float, mean_log: float) -> tuple[float, float]:
    """(degrees of freedom, scale) of the chi law of largest likelihood, from the mean of r ** 2 and of log(r).

    r ** 2 has a gamma law, for which these two are all that counts.
    """
    target = np.log(mean_square) - 2 * mean_log
    if not target > 1e-12:  # all radii are equal
        return np.inf, 0.0
    a = (3 - target + np.sqrt((target - 3) ** 2 + 24 * target)) / (12 * target)
    for _ in range(50):
        before, a = a, trigamma_step(a, target)
        if abs(a - before) <= 1e-14 * a:
            break
    return 2 * a, float(np.sqrt(mean_square / (2 * a)))


def gamma_below(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    out = np.zeros(len(x))
    scale = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - np.array([lgamma(v) for v in a]))
    low = (x < a + 1) & (x > 0)
    if low.any():
        term = total = 1 / a[low]
        n = a[low].copy()
        while (np.abs(term) > 1e-16 * np.abs(total)).any():
            n = n + 1
            term = term * x[low] / n
            total = total + term
        out[low] = total * scale[low]
    high = x >= a + 1
    if high.any():
        b = x[high] + 1 - a[high]
        c, d = np.full(high.sum(), 1e300), 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - a[high])
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = 1 - scale[high] * h
    return out


def peaks(density: np.ndarray) -> list[int]:
    """Places of peaks (of plateaus the middle) that stand out from the higher of their two bases by PROMINENCE of the highest density."""
    found, i, n = [], 1, len(density)
    while i < n - 1:
        if density[i - 1] < density[i]:
            j = i
            while j < n - 1 and density[j + 1] == density[i]:
                j += 1
            if j < n - 1 and density[j + 1] < density[i]:
                top = (i + j) // 2
                higher = np.flatnonzero(density[:top] > density[top])
                left = density[(higher[-1] if len(higher) else 0) : top + 1].min()
                higher = np.flatnonzero(density[top + 1 :] > density[top])
                right = density[top : top + 1 + (higher[0] + 1 if len(higher) else n)].min()
                if density[top] - max(left, right) >= PROMINENCE * density.max():
                    found.append(top)
            i = j
        i += 1
    return found


def kolmogorov(n: int, distance: float) -> float:
    """The chance of a larger distance for n values of the law, by the limit law with a correction for n."""
    x = (np.sqrt(n) + 0.12 + 0.11 / np.sqrt(n)) * distance
    if x < 0.2:
        return 1.0
    k = np.arange(1, 101)
    return float(np.clip(2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k**2 * x**2)), 0, 1))


def densities(ranked: DataFrame, stats: DataFrame) -> DataFrame:
    """Sums of Gaussian kernels (bandwidth: Scott's) at GRID points from the least to the largest radius: cluster, i, density."""

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pandas()
            for c, part in t.groupby("cluster", dropna=False):
                near, far, width = part["near"].iloc[0], part["far"].iloc[0], part["width"].iloc[0]
                grid, total = np.linspace(near, far, GRID), np.zeros(GRID)
                r = part["radius"].to_numpy()
                for at in range(0, len(r), 2_000):
                    total += np.exp(-(((grid[None, :] - r[at : at + 2_000, None]) / width) ** 2) / 2).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array([c] * GRID, batch.schema.field("cluster").type), pa.array(np.arange(GRID, dtype=np.int32)), pa.array(total)], ["cluster", "i", "density"])

    kind = ranked.schema["cluster"].dataType.simpleString()
    rows = ranked.select("cluster", "radius").join(stats.filter("width > 0").select("cluster", "near", "far", "width"), "cluster")
    return rows.mapInArrow(kernels, f"cluster {kind}, i int, density double").groupBy("cluster", "i").agg(F.sum("density").alias("density"))


def fits(ranked: DataFrame) -> DataFrame:
    """ranked (see layout.radii): per cluster n, mode (place of the highest prominent peak, as a share of the largest radius; null
    without one), peaks, chi_df, chi_scale, ks, ks_p and gaussian_like.

    Clusters whose radii are all equal, or hold a zero, have no fit: nulls.
    """
    ranked = stored(ranked.select("cluster", "radius", "rank", "n"), "ranked")
    width = F.stddev_samp("radius") * F.pow(F.count("*"), F.lit(-0.2))
    stats = stored(ranked.groupBy("cluster").agg(F.count("*").alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far"), width.alias("width"), F.avg(F.col("radius") * F.col("radius")).alias("square"), F.avg(F.when(F.col("radius") > 0, F.log("radius"))).alias("log")), "stats")
    curve = densities(ranked, stats).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "density"))), lambda p: p["density"]).alias("curve"))  # GRID values
    kind = ranked.schema["cluster"].dataType.simpleString()

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for r in t.itertuples(index=False):
                df, scale = chi_fit(r.square, r.log) if r.near > 0 and r.far > r.near else (None, None)
                found = [] if r.curve is None else peaks(np.asarray(r.curve))
                mode = None if not found else np.linspace(r.near, r.far, GRID)[max(found, key=lambda i: r.curve[i])] / r.far
                out.append((r.cluster, r.n, mode, len(found), df, scale))
            yield pd.DataFrame(out, columns=["cluster", "n", "mode", "peaks", "chi_df", "chi_scale"])

    of = stored(stats.join(curve, "cluster", "left").mapInPandas(fitted, f"cluster {kind}, n long, mode double, peaks int, chi_df double, chi_scale double"), "fits")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, rank, n, df, scale = (batch.column(c).to_numpy().astype(float) for c in ("radius", "rank", "n", "chi_df", "chi_scale"))
            law = gamma_below(df / 2, (r / scale) ** 2 / 2)
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), pa.array(np.maximum(rank / n - law, law - (rank - 1) / n))], ["cluster", "d"])

    known = of.filter("chi_scale > 0").select("cluster", "chi_df", "chi_scale")
    ks = ranked.join(known, "cluster").select("cluster", "radius", "rank", "n", "chi_df", "chi_scale").mapInArrow(apart, f"cluster {kind}, d double").groupBy("cluster").agg(F.max("d").alias("ks"))

    def chances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield t.assign(ks_p=[kolmogorov(n, d) if d == d and d is not None else None for n, d in zip(t["n"], t["ks"], strict=True)])

    rows = of.join(ks, "cluster", "left").select("cluster", "n", "mode", "peaks", "chi_df", "chi_scale", "ks")
    return rows.mapInPandas(chances, f"cluster {kind}, n long, mode double, peaks int, chi_df double, chi_scale double, ks double, ks_p double").withColumn("gaussian_like", F.col("ks_p") > LEVEL)


def draws(vectors: DataFrame, times: int, seed: int, size: int | None = None) -> DataFrame:
    """vectors (cluster, key, v) with ``draw``: for each draw exactly ``size`` of every cluster (of a smaller one all), without replacement.

    Without a size it is that of the smallest cluster.  A draw takes the smallest digests of (seed, draw, key), so that it is the same for any
    dealing.  Its threshold is found by counts in buckets of the digests' range; only the bucket it lies in is ranked.
    """
    sizes = stored(vectors.groupBy(F.col("cluster").alias("_c")).agg(F.count("*").alias("_all")), "sizes")
    m = size if size is not None else sizes.agg(F.min("_all")).first()[0] or 0
    digest = F.xxhash64(F.lit(seed), F.col("draw"), F.col("key"))
    # The upper 32 bits are dealt evenly to the cluster's buckets.
    bucket = F.floor(F.shiftrightunsigned(digest, 32) * F.col("_buckets") / F.lit(1 << 32)).cast("long")
    rows = vectors.select("cluster", "key").join(sizes, F.col("cluster").eqNullSafe(F.col("_c"))).withColumns({"_buckets": F.ceil(F.col("_all") / BUCKET), "draw": F.explode(F.sequence(F.lit(0), F.lit(times - 1)))})
    rows = rows.select("cluster", "key", "draw", digest.alias("_digest"), bucket.alias("_bucket"))
    counts = rows.groupBy("cluster", "draw", "_bucket").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy("cluster", "draw").orderBy("_bucket"))  # a row for each 1,000 of the cluster
    border = counts.withColumn("_upto", upto).withColumn("_left", m - F.col("_upto") + F.col("_n")).filter("_left > 0")
    place = F.row_number().over(W.partitionBy("cluster", "draw", "_bucket").orderBy("_digest", "key"))
    on = border.select(F.col("cluster").alias("_c"), F.col("draw").alias("_d"), F.col("_bucket").alias("_b"), "_left", "_n")
    near = rows.join(on, F.col("cluster").eqNullSafe(F.col("_c")) & (F.col("draw") == F.col("_d")) & (F.col("_bucket") == F.col("_b")))
    inside = near.filter("_left >= _n").select("cluster", "key", "draw")
    edge = near.filter("_left < _n").withColumn("_place", place).filter("_place <= _left").select("cluster", "key", "draw")
    taken = inside.unionByName(edge).select(F.col("cluster").alias("_c"), F.col("key").alias("_k"), "draw")
    return vectors.join(taken, F.col("cluster").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k"))).drop("_c", "_k")


def resampled(vectors: DataFrame, times: int = 25, seed: int = 0) -> DataFrame:
    """Per cluster the effective dimension on equal terms: the mean over draws of as many vectors as the smallest cluster has."""
    one = draws(vectors, times, seed).select(F.struct("cluster", "draw").alias("cluster"), "key", "v")
    each = profile(radii(stored(one, "draws")))
    return each.groupBy(F.col("cluster.cluster").alias("cluster")).agg(F.max("n").alias("n"), F.count("*").alias("draws"), F.avg("dimension").alias("dimension"))


def direction_auc(vectors: DataFrame, pairs: DataFrame, held_out: Column) -> DataFrame:
    """How well the difference of two classes' means tells their held-out vectors apart: first, second, n_first, n_second, auc.

    vectors (key, label, v); pairs (first, second) of labels.  A direction is learned from rows that are not held out.  The area is
    that of the rank sum, tied scores having the mean of their ranks; scores are rounded to 9 places.
    """
    means = vectors.filter(~held_out).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    mean = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    sides = pairs.join(mean.toDF("first", "a"), "first").join(mean.toDF("second", "b"), "second")
    directions = stored(sides.select("first", "second", F.zip_with("a", "b", lambda x, y: x - y).alias("direction")), "directions")
    side = directions.select("first", "second", "direction", F.col("first").alias("label"), F.lit(1).alias("is_first")).unionByName(directions.select("first", "second", "direction", F.col("second").alias("label"), F.lit(0).alias("is_first")))
    scores = vectors.filter(held_out).join(side, "label").select("first", "second", "is_first", "key", F.round(dot(F.col("v"), F.col("direction")), 9).alias("score"))
    line = numbered(scores, "at", "first", "second", "score", "key")
    base = line.groupBy("first", "second").agg(F.min("at").alias("base"), F.sum("is_first").alias("n_first"), F.count("*").alias("n"))
    tied = line.groupBy("first", "second", "score").agg(F.avg("at").alias("rank"), F.sum("is_first").alias("firsts"))
    sums = tied.groupBy("first", "second").agg(F.sum(F.col("rank") * F.col("firsts")).alias("sum"))
    both = base.join(sums, ["first", "second"])
    n1, n2 = F.col("n_first"), F.col("n") - F.col("n_first")
    area = (F.col("sum") - n1 * (F.col("base") - 1) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n2, F.lit(0))
    return both.select("first", "second", n1.alias("n_first"), n2.alias("n_second"), area.alias("auc"))
