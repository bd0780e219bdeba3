"""Many vectors: what is shipped grows as they do, tasks stay small, and neighbours are the same."""

import numpy as np

from larkspar.operators import neighbours
from test_neighbours import SCHEMA, plain


def shipped(spark, monkeypatch, n):
    sent, real = [], neighbours.routed

    def counted(rows, bounds, cells, pivots):
        sent.append(sum(parts for *_, parts in cells))
        return real(rows, bounds, cells, pivots)

    monkeypatch.setattr(neighbours, "routed", counted)
    rows = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(2).normal(size=(n, 12)).round(1))]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), 3).collect()
    monkeypatch.setattr(neighbours, "routed", real)
    assert {(r.key, r.rank, r.other, round(r.cosine, 9) + 0.0) for r in got} == plain(rows, 3)
    return sent[0]


def test_vectors_are_shipped_to_no_more_blocks_when_there_are_more_of_them(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "MANY", 60, raising=False)
    monkeypatch.setattr(neighbours, "ASKING", 100, raising=False)
    monkeypatch.setattr(neighbours, "AT_ONCE", 500, raising=False)
    assert shipped(spark, monkeypatch, 600) <= 2 * 8
