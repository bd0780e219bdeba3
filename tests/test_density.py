"""The cut of the density hierarchy against all pairs, with groups of copies."""

import numpy as np

from larkspar.operators import neighbours


def brute(v, min_samples, radius, least):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(0, 2 - 2 * np.round(v @ v.T, 12)))
    core = np.sort(d + 9 * np.eye(len(v)), axis=1)[:, min_samples - 1]
    near = (d <= radius) & (core <= radius)[:, None] & (core <= radius)[None, :]
    label = np.arange(len(v))
    while not np.array_equal(label, new := np.array([min(label[near[i]], default=label[i]) for i in range(len(v))])):
        label = new
    return {i: int(label[i]) if core[i] <= radius and (label == label[i]).sum() >= least else -1 for i in range(len(v))}


def test_density_clusters_join_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    r = np.random.default_rng(8)
    copies = np.concatenate([np.repeat([[1.0, 0.05 * g, 0, 0, 0, 0]], 7, 0) for g in range(3)])
    v = np.concatenate([copies, r.normal(size=(60, 6))])
    for radius in (0.1, 0.6):
        rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, v array<double>")
        got = {x.key: x.cluster_id for x in neighbours.density_clusters(rows, 5, radius, 5).collect()}
        assert got == brute(v, 5, radius, 5)
    assert {got[i] for i in range(21)} == {0}
