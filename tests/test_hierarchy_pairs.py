"""Forests between two blocks, what is shipped to blocks, and what is not shipped by way of the driver."""

import numpy as np
from pyspark.sql import functions as F

from larkspar.operators import hierarchy


def kruskal(weights, rank):
    n, left = len(rank), len(weights)
    edges = sorted((weights[i, j], min(rank[i], rank[left + j]), max(rank[i], rank[left + j])) for i in range(left) for j in range(n - left))
    label, out = list(range(n)), set()
    for _, a, b in edges:
        if label[a] != label[b]:
            label = [label[a] if x == label[b] else x for x in label]
            out.add((a, b))
    return out


def test_the_tree_between_two_sides_with_ties():
    r = np.random.default_rng(3)
    for left, right in ((1, 1), (1, 5), (6, 2), (9, 14)):
        weights = r.integers(0, 4, (left, right)).astype(float)
        rank = r.permutation(left + right)
        assert {tuple(e) for e in hierarchy.prim_between(weights, rank).tolist()} == kruskal(weights, rank)


def made(spark, n):
    v = F.array(*[F.sin(F.col("id") * (i + 2) * 1.37).alias(f"v{i}") for i in range(4)])
    return spark.range(n).select(F.lit(0).alias("group"), F.col("id").alias("key"), v.alias("v"))


def test_pairs_of_blocks_leave_edges_within_a_block_once(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 10)
    n = 80
    rows = hierarchy.points(made(spark, n)).withColumn("core", F.array(F.lit(0.0)))
    blocks = hierarchy.paired(rows).filter("bi = bj").groupBy("bi").count().toPandas()["count"].tolist()
    edges = hierarchy.candidate_edges(rows, 1).collect()
    k = len(blocks)
    # Within: a block's size less one; between: the sizes of both less one.
    assert k > 2 and len(edges) == n - k + (k - 1) * n - k * (k - 1) // 2
    assert len({(e.a, e.b) for e in edges}) == len(edges)


def test_blocks_of_large_groups_are_wider(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 10)
    met = hierarchy.paired(hierarchy.points(made(spark, 600)))
    assert met.groupBy("place").count().agg(F.max("count")).first()[0] == 20  # 60 before


def test_points_are_not_shipped_by_way_of_the_driver(spark, monkeypatch):
    whole, seen = hierarchy.stored, set()

    def watched(df, name, folder=None):
        seen.add(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
        return whole(df, name, folder)

    monkeypatch.setattr(hierarchy, "stored", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found, tree = hierarchy.clustered(made(spark, 60), [5])
    assert seen == {"-1"} and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert found.count() == 60 and tree.count() == 59
