"""Rolling medians whose windows are wider than a part, against a plain window."""

import numpy as np
import pytest

from larkspar.operators import layout


@pytest.mark.parametrize(("n", "k", "part"), [(300, 61, 20), (300, 60, 7), (97, 96, 10), (120, 30, 29), (64, 64, 5)])
@pytest.mark.parametrize("kind", ["free", "ties", "rising"])
def test_wide_medians_equal_plain_windows(spark, n, k, part, kind):
    r = np.random.default_rng(n + k)
    x = {"free": r.normal(size=n), "ties": r.integers(0, 4, n).astype(float), "rising": np.arange(n) * 1.0}[kind]
    rows = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(x)], "position long, value double")
    got = {t.position: t.median for t in layout.wide_medians(rows.repartition(3), n, k, part).collect()}
    before, after = k // 2, k - k // 2 - 1
    padded = np.concatenate([np.repeat(x[0], before), x, np.repeat(x[-1], after)])
    assert got == {i + 1: float(np.median(padded[i : i + k])) for i in range(n)}


def test_wide_and_narrow_parts_agree(spark):
    r = np.random.default_rng(5)
    rows = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(r.integers(0, 50, 1_500))], "position long, value double")
    narrow = {tuple(t) for t in layout.rolling_median(rows, "value", part=40).select("position", "median").collect()}
    assert narrow == {tuple(t) for t in layout.rolling_median(rows, "value", part=3).select("position", "median").collect()}
