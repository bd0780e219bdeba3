"""Spectral orders against dense eigenvectors."""

import numpy as np
import pytest

from larkspar.operators import layout, spectral

SCHEMA = "key long, v array<double>"


def unit(seed, n, d):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) + 2 * np.sin(np.linspace(0, 3, n))[:, None] * r.normal(size=d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dense(x, keys, similarity):
    w = similarity(x @ x.T)
    np.fill_diagonal(w, 0)
    values, vectors = np.linalg.eigh(np.diag(w.sum(1)) - w)
    second = vectors[:, 1]
    second = second if second[np.argmin(keys)] <= 0 else -second
    even = np.round(second / np.abs(second).max(), 9)
    return [keys[i] for i in sorted(range(len(keys)), key=lambda i: (even[i] + 0.0, keys[i]))]


@pytest.mark.parametrize(("n", "d"), [(3, 2), (40, 5), (200, 12), (12, 30)])
def test_image_order_is_that_of_dense_eigenvectors(spark, n, d):
    x, keys = unit(n, n, d), [int(k) for k in np.random.default_rng(1).permutation(n)]
    if n == 40:
        x[7] = x[9]
    got = spectral.image_order(spark.createDataFrame(list(zip(keys, x.tolist(), strict=True)), SCHEMA).repartition(3)).collect()
    assert [r.key for r in sorted(got, key=lambda r: r.place)] == dense(x, keys, lambda g: g + 1)
    assert sorted(r.place for r in got) == list(range(1, n + 1))


@pytest.mark.parametrize("n", [4, 30])
def test_clipped_order_is_that_of_dense_eigenvectors(spark, monkeypatch, n):
    monkeypatch.setattr(spectral, "BLOCK", 7)
    x, keys = unit(n + 1, n, 6), list(range(n))
    got = spectral.clipped_order(spark.createDataFrame(list(zip(keys, x.tolist(), strict=True)), SCHEMA)).collect()
    assert [r.key for r in sorted(got, key=lambda r: r.place)] == dense(x, keys, lambda g: np.clip(g, 0, None))


def test_orders_of_clusters_by_blocks_and_at_once_agree(spark, monkeypatch):
    x = unit(5, 60, 6)
    rows = spark.createDataFrame([(i % 12, i, v.tolist()) for i, v in enumerate(x)], "cluster long, key long, v array<double>")
    once = {tuple(r) for r in layout.spectral_order(rows).collect()}
    monkeypatch.setattr(layout, "FEW_CLUSTERS", 3)
    assert {tuple(r) for r in layout.spectral_order(rows).collect()} == once


def test_few_vectors_keep_the_order_of_their_keys(spark):
    assert spectral.image_order(spark.createDataFrame([], SCHEMA)).count() == 0
    two = spark.createDataFrame([(5, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA)
    assert {(r.key, r.place) for r in spectral.image_order(two).collect()} == {(2, 1), (5, 2)}
