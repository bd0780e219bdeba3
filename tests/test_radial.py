"""Radial fits against plain formulas, draws, and the area of a direction."""

from collections import Counter, defaultdict
from math import erf, exp, pi, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspar.operators import layout, radial

SCHEMA = "cluster long, key long, v array<double>"


def rows_of(seed, sizes, d=4):
    r = np.random.default_rng(seed)
    out = []
    for c, n in enumerate(sizes):
        x = r.normal(size=(n, d)) * r.choice([0.2, 1.0, 3.0])
        out += [(c, 1000 * c + i, v.tolist()) for i, v in enumerate(x)]
    return out


def radii_of(rows):
    by = defaultdict(list)
    for c, _, v in rows:
        by[c].append(v)
    return {c: np.sort(np.round(np.linalg.norm(np.array(v) - np.mean(v, 0), axis=1), 9)) for c, v in by.items()}


def test_fits_match_plain_formulas(spark):
    rows = rows_of(1, [150, 40, 12, 3])
    # Two shells: the density of their radii has two peaks.
    r = np.random.default_rng(2).normal(size=(300, 4))
    rows += [(9, 9_000 + i, (v / np.linalg.norm(v) * (8 if i % 2 else 2) * (1 + 0.1 * v[0])).tolist()) for i, v in enumerate(r)]
    got = {x.cluster: x for x in radial.fits(layout.radii(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()}
    for c, r in radii_of(rows).items():
        n, grid = len(r), np.linspace(r[0], r[-1], 400)
        width = r.std(ddof=1) * n**-0.2
        curve = np.exp(-(((grid[:, None] - r[None, :]) / width) ** 2) / 2).sum(1)
        tops = []
        for i in range(1, 399):
            if curve[i - 1] < curve[i] > curve[i + 1]:
                left = [j for j in range(i) if curve[j] > curve[i]]
                right = [j for j in range(i + 1, 400) if curve[j] > curve[i]]
                base = max(curve[(left[-1] if left else 0) : i].min(), curve[i + 1 : (right[0] + 1 if right else 400)].min())
                if curve[i] - base >= 0.15 * curve.max():
                    tops.append(i)
        assert got[c].peaks == len(tops) and got[c].n == n
        if tops:
            assert abs(got[c].mode - grid[max(tops, key=lambda i: curve[i])] / r[-1]) < 1e-9
        # The likelihood falls off on all sides of the fit, and the law's distance is the largest at any radius.
        df, scale = got[c].chi_df, got[c].chi_scale
        likelihood = lambda k, s: np.sum((k - 1) * np.log(r) - (r / s) ** 2 / 2) - n * (k * np.log(s) + (k / 2 - 1) * np.log(2) + lgamma_(k / 2))
        best = likelihood(df, scale)
        assert all(likelihood(df * a, scale * b) < best for a in (0.999, 1, 1.001) for b in (0.999, 1, 1.001) if (a, b) != (1, 1))
        law = np.array([chi_law(x, df, scale) for x in r])
        assert abs(got[c].ks - max(np.max(np.arange(1, n + 1) / n - law), np.max(law - np.arange(n) / n))) < 1e-6
        assert got[c].gaussian_like == (got[c].ks_p > 0.05)
    assert got[9].peaks >= 1 and not got[9].gaussian_like and got[0].gaussian_like


def lgamma_(x):
    from math import lgamma

    return lgamma(x)


def chi_law(x, df, scale, steps=20_000):
    """By the midpoint rule."""
    t = (np.arange(steps) + 0.5) * (x / scale) / steps
    return float(np.sum(np.exp((df - 1) * np.log(t) - t**2 / 2 - (df / 2 - 1) * np.log(2) - lgamma_(df / 2))) * (x / scale) / steps)


def test_gamma_law_and_fit_against_known_values():
    x = np.array([0.0, 0.1, 0.5, 1, 2, 5, 30])
    assert np.allclose(radial.gamma_below(np.full(7, 0.5), x), [erf(sqrt(v)) for v in x], atol=1e-14)
    assert np.allclose(radial.gamma_below(np.full(7, 2.0), x), [1 - exp(-v) * (1 + v) for v in x], atol=1e-14)
    y = np.random.default_rng(0).chisquare(7, 200_000) * 2.25
    df, scale = radial.chi_fit(y.mean(), np.log(y).mean() / 2)
    assert abs(df - 7) < 0.1 and abs(scale - 1.5) < 0.02
    assert abs(radial.kolmogorov(100, 0.1358) - 0.05) < 0.005 and radial.kolmogorov(10, 0) == 1 and pi > 3


def test_equal_radii_have_no_fit(spark):
    rows = [(0, i, [float(i % 2), 0.0]) for i in range(4)] + [(1, 9, [1.0, 1.0])] + [(2, 20 + i, [1.0, 1.0]) for i in range(3)]
    got = radial.fits(layout.radii(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {(r.cluster, r.mode, r.peaks, r.chi_df, r.ks, r.gaussian_like) for r in got} == {(c, None, 0, None, None, None) for c in range(3)}


@pytest.mark.parametrize("bucket", [1_000, 7])
def test_draws_are_exact_and_do_not_depend_on_dealing(spark, monkeypatch, bucket):
    monkeypatch.setattr(radial, "BUCKET", bucket)
    rows = rows_of(3, [60, 23, 11])
    df = spark.createDataFrame(rows, SCHEMA)
    one = {(r.cluster, r.key, r.draw) for r in radial.draws(df, 6, 1).collect()}
    assert one == {(r.cluster, r.key, r.draw) for r in radial.draws(df.repartition(7), 6, 1).collect()}
    assert Counter((c, d) for c, _, d in one) == {(c, d): 11 for c in range(3) for d in range(6)}
    assert len({frozenset(k for c, k, d in one if c == 0 and d == x) for x in range(6)}) == 6
    assert Counter(r.draw for r in radial.draws(df, 2, 1, 40).collect()) == {0: 40 + 23 + 11, 1: 40 + 23 + 11}
    assert radial.draws(df.limit(0), 2, 1).count() == 0


def test_resampled_dimensions_are_means_over_draws(spark):
    df = spark.createDataFrame(rows_of(4, [80, 30]), SCHEMA)
    got = {r.cluster: r for r in radial.resampled(df, 4, 2).collect()}
    for c in (0, 1):
        each = []
        for d in range(4):
            own = radial.draws(df, 4, 2).filter((F.col("cluster") == c) & (F.col("draw") == d))
            each.append(layout.profile(layout.radii(own.drop("draw"))).first().dimension)
        assert got[c].n == 30 and got[c].draws == 4 and abs(got[c].dimension - np.mean(each)) < 1e-5


def test_area_of_a_direction_with_ties(spark):
    r = np.random.default_rng(5)
    rows = [(i, i % 3, np.round(r.normal(size=2) + (i % 3), 0).tolist()) for i in range(90)]
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "first long, second long")
    got = {(x.first, x.second): x for x in radial.direction_auc(spark.createDataFrame(rows, "key long, label long, v array<double>"), pairs, F.col("key") % 2 == 1).collect()}
    for a, b in ((0, 1), (0, 2)):
        mean = lambda c: np.mean([v for k, x, v in rows if x == c and k % 2 == 0], 0)
        along = lambda c: [round(float(np.dot(v, mean(a) - mean(b))), 9) for k, x, v in rows if x == c and k % 2]
        wins = [(x > y) + (x == y) / 2 for x in along(a) for y in along(b)]
        assert abs(got[a, b].auc - np.mean(wins)) < 1e-12 and got[a, b].n_first == 15
