"""Exact neighbours: pruned block by block, equal to comparing all pairs."""

import numpy as np
import pytest

from larkspar.operators import neighbours

SCHEMA = "key long, v array<double>"


def plain(rows, k):
    keys, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = set()
    for i, a in enumerate(keys):
        others = sorted((-round(float(c), 12) + 0.0, int(b)) for b, c in zip(keys, x @ x[i], strict=True) if b != a)
        out |= {(int(a), n + 1, b, round(-c, 9)) for n, (c, b) in enumerate(others[:k])}
    return out


def clouds(n, spread, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 8))
    rows = [(int(i * 7 % 1009), (centres[i % 12] + spread * r.normal(size=8)).tolist()) for i in range(n)]
    return rows + [(5_000, rows[0][1]), (5_001, rows[0][1]), (5_002, [0.0] * 8), (5_003, [0.0] * 8)]


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_pruned_search_equals_all_pairs(spark, monkeypatch, k, spread):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rows = clouds(200, spread)
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), k).collect()
    assert {(r.key, r.rank, r.other, round(r.cosine, 9) + 0.0) for r in got} == plain(rows, k)


def test_most_blocks_of_separate_clouds_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    visits = []
    real = neighbours.routed

    def counted(rows, bounds, cells, pivots):
        found = real(rows, bounds, cells, pivots)
        visits.append((found.count(), rows.count() * (sum(n for *_, n in cells) - 1)))
        return found

    monkeypatch.setattr(neighbours, "routed", counted)
    rows = [r for r in clouds(400, 0.05, 3) if r[0] < 5_002]
    assert {(r.key, r.rank, r.other, round(r.cosine, 9) + 0.0) for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA), 1).collect()} == plain(rows, 1)
    assert visits[0][0] < 0.35 * visits[0][1]


def test_few_vectors(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, [1.0])], SCHEMA), 3).count() == 0
    got = neighbours.nearest(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], SCHEMA), 3).collect()
    assert {(r.key, r.rank, r.other, r.cosine) for r in got} == {(1, 1, 2, 0.0), (2, 1, 1, 0.0)}
