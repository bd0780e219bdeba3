"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspar.storage import Scratch, stored


#: So many edges are few MB: one task joins them.
FEW_EDGES = 100_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, given edges a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        if np.array_equal(label, before):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = [b for b in batches if b.num_rows]
    if both:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in both]) for c in ("u", "v"))
        node, number = np.unique(np.r_[u, v], return_inverse=True)
        label = forest(len(node), number[: len(u)], number[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns node, component for all nodes with edges: the smallest node reachable.

    Alternates stars: every node's larger neighbours move to its smallest neighbour, then its smaller
    ones do.  The number of rounds grows with the logarithm of the longest path; the edges stay on the
    executors and are written after each round, in place of those of the round before.  No more than
    FEW_EDGES are joined by one task, at the beginning or once the stars are so few.
    """
    bigger = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    with Scratch(edges.sparkSession) as scratch:
        edges = scratch.stored(edges.filter("u <> v").select(*bigger).distinct(), "edges")
        seen = fingerprint(edges)
        while seen[0] > FEW_EDGES:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            small = moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").select(*bigger).distinct()
            before, edges = edges, scratch.stored(small, "edges")
            scratch.drop(before)
            now = fingerprint(edges)
            if now == seen:
                break
            seen = now
        if seen[0] <= FEW_EDGES:
            return stored(edges.coalesce(1).mapInArrow(in_one_task, "node long, component long"), "components")
        roots = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
        own = roots.select(F.col("component").alias("node"), "component").distinct()
        return stored(roots.unionByName(own), "components")
