import math

import numpy as np
import pytest

from larkspar.llm import op13_whitening
from larkspar.llm.op13_whitening import Spectrum, rank_one, secular_roots, whiten

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(rows, components, scale=64, offset=1_000_000):
    """From whole matrices; whitened and explained of components that have variance."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(scale * float(np.float32(c))) + offset for c in v] for _, v in good], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True))) for row in x]
    centred = x.astype(float) - s.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    some = int((values[:components] > 1e-13 * values[0]).sum())
    return good, n, deviation, centred @ axes[:, :some] / np.sqrt(values[:some]), values[:some] / values.sum()


def compared(got, rows, components):
    good, n, deviation, whitened, explained = by_hand(rows, components)
    some = len(explained)
    assert len(got) == len(good) * some and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, some + 1))
    assert max(abs(r.explained / explained[r.component - 1] - 1) for r in got) < 1e-9
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r
    assert {i: t[1].deviation for i, t in table.items()} == {i: d for (i, _), d in zip(good, deviation, strict=True)}
    w = np.array([[table[i][k].whitened for k in range(1, some + 1)] for i, _ in good])
    sign = np.sign((w * whitened).sum(0))
    assert np.abs(w * sign - whitened).max() < 1e-6
    error = np.abs(np.cov(w.T, bias=True).reshape(some, some) - np.eye(some)).max()
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9 and abs(error - got[0].identity_error) < 1e-9


def vectors(n, d, seed):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * np.linspace(3, 0.1, d) @ r.normal(size=(d, d))).astype(np.float32)


def test_matches_whole_matrices(spark):
    bad = [(900, None), (901, []), (902, [1.0] * 8 + [None]), (903, [float("nan")] * 9), (904, [1.0] * 8 + [float("-inf")])]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(200, 9, 1))]
    got = whiten(spark.createDataFrame(rows + bad + [(905, [1.0, 2.0])], SCHEMA).repartition(7), 5).collect()
    compared(got, rows, 5)


def test_spectra_of_many_tasks_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(op13_whitening, "FAN", 2)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(60, 4, 2))]
    compared(whiten(spark.createDataFrame(rows, SCHEMA).repartition(11), 32).collect(), rows, 32)


def test_few_repeated_and_equal_rows(spark):
    rows = [(i, [float(i % 2), 1.0, float(i % 2)]) for i in range(6)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    compared(got, rows, 32)
    assert {r.component for r in got} == {1} and {abs(round(r.whitened, 9)) for r in got} == {1.0}
    equal = spark.createDataFrame([(None, [1.0, 2.0])] * 3, SCHEMA)
    assert whiten(equal).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and whiten(equal).count() == 0
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(None, [1.0, 2.0], 1, 2, "x"), (None, [2.0, 5.0], 1, 2, "y")], SCHEMA + ", x int, ID int, component string")
    assert [(r.vec_id, r.component) for r in whiten(clash).collect()] == [(None, 1), (None, 1)]


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [1e12 * i, -1e12 * i]) for i in range(3)] + [(3, [0.0, 1.0])]
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    assert got[2] is None and len(got) == 4


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_roots_and_updates_against_numpy(n):
    r = np.random.default_rng(n)
    for spread in (1, 1e6, 1e-6):
        poles = np.sort(r.random(n)) * spread
        poles[n // 2 :] += 1e-9 * np.arange(n - n // 2)
        z = r.normal(size=n) * np.where(r.random(n) < 0.3, 1e-5, 1)
        if len(np.unique(poles)) == n:
            delta = secular_roots(poles, z**2)
            assert np.allclose(np.sort(np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z))), poles - delta[np.arange(n), np.arange(n)], rtol=1e-12, atol=1e-13 * max(spread, z @ z))
        values, vectors_ = rank_one(poles, np.eye(n), z)
        assert np.abs(vectors_ @ np.diag(values) @ vectors_.T - np.diag(poles) - np.outer(z, z)).max() < 1e-12 * max(spread, z @ z)
        assert np.abs(vectors_.T @ vectors_ - np.eye(n)).max() < 1e-12


def test_a_spectrum_does_not_depend_on_how_vectors_are_split():
    x = np.floor(64 * vectors(90, 6, 5)).astype(np.int64)
    one, parts = Spectrum.empty(6), [Spectrum.empty(6) for _ in range(3)]
    for i, v in enumerate(x):
        one.add(v)
        parts[i % 3].add(v)
    whole = Spectrum.empty(6)
    for p in parts:
        whole.combine(p)
    assert whole.n == 90 and np.array_equal(whole.sums, one.sums) and np.allclose(whole.values, one.values, rtol=1e-10)
