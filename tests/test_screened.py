"""Blocks of any size: neighbours and trees tile by tile are those of whole matrices; and what large inputs ship and leave."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspar.operators import hierarchy, screened
from tests.test_hierarchy import SCHEMA, plain, vectors

SIZES = [2, 5, 9]


def drawn(kind, n, r):
    x = r.normal(size=(n, 6))
    if kind == "clusters":
        x = 5 * r.normal(size=(5, 6))[r.integers(0, 5, n)] + x * r.choice([0.01, 0.3, 1], n)[:, None]
    if kind == "copies":
        x[r.random(n) < 0.6] = x[0]
    if kind == "ties":
        x = r.integers(-1, 2, (n, 6)).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def edges(tree):
    a, b, _ = tree
    assert (a < b).all()
    return set(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize(("kind", "n", "tile"), [("noise", 1, 64), ("noise", 2, 64), ("noise", 300, 64), ("clusters", 300, 64), ("clusters", 500, 2048), ("copies", 257, 64), ("ties", 400, 32)])
def test_tiles_find_what_whole_matrices_hold(monkeypatch, kind, n, tile):
    for name, value in {"TILE": tile, "PART": tile // 4, "AT_ONCE": 50, "BESIDE": 0.5}.items():
        monkeypatch.setattr(screened, name, value)
    r = np.random.default_rng(n)
    x, every = drawn(kind, n, r), np.arange(n)
    closest = screened.Closest(x, 3 * every, max(SIZES))
    for at in range(0, n, 70):
        closest.meet(x[at : at + 70], 3 * every[at : at + 70])
    core, d = closest.distances(SIZES), hierarchy.distances(x, x)
    d[every, every] = np.inf
    assert n == 1 or np.allclose(core, np.sort(d, axis=1)[:, [min(s, n - 1) - 1 for s in SIZES]], atol=1e-11)
    whole = list(map(edges, hierarchy.full_trees(x, core, every, every, True)))
    assert n == 1 or list(map(edges, hierarchy.screened_trees(x, core, every, every, True))) == whole
    side = r.random(n) < 0.5
    i, j = np.flatnonzero(side), np.flatnonzero(~side)
    for of_all, between, found in zip(whole, hierarchy.full_trees(x, core, i, j, False), hierarchy.screened_trees(x, core, i, j, False), strict=False):
        # No edge of the tree of all is missing, and none is there that the tree between the sides has not.
        assert {(a, b) for a, b in of_all if side[a] != side[b]} <= edges(found) <= edges(between)


def made(spark, n):
    v = F.array(*[F.sin(F.col("id") * (i + 2) * 1.37) for i in range(4)])
    return spark.range(n).select(F.lit(0).alias("group"), F.col("id").alias("key"), v.alias("v"))


def test_vectors_are_shipped_as_often_however_many(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 10)
    for n in (1200, 2400):
        met = hierarchy.paired(hierarchy.points(made(spark, n)))
        assert met.groupBy("place").count().agg(F.max("count")).first()[0] == 20  # 40 and 80 before


def test_single_precision_is_shipped_where_it_is_exact(spark):
    singles = made(spark, 9).withColumn("v", F.transform("v", lambda c: c.cast("float").cast("double")))
    assert [hierarchy.points(df).schema["v"].dataType.simpleString() for df in (made(spark, 9), singles)] == ["array<double>", "array<float>"]


def test_large_blocks_match_the_plain_version_and_leave_the_result_only(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 16)
    monkeypatch.setattr(hierarchy, "DENSE", 4)
    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "larkspar"
    tables = lambda: {p.parent for p in shared.rglob("part-*")}
    rows, before = vectors(1, 60), tables()
    got = {r.key: (r.cluster_id, round(r.probability, 9)) for r in hierarchy.sweep(spark.createDataFrame(rows, SCHEMA).select("key", "v").repartition(3), [3]).collect()}
    assert got == {k: (c, round(p, 9)) for k, (c, p) in plain(rows, 3, "eom")[0].items()}
    assert {p.name for p in tables() - before} == {"clustered", "tree"}
