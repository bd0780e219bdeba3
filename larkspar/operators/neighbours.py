"""Exact nearest neighbours by matrix products of the blocks that may hold them, and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.operators.components import components, forest
from larkspar.storage import Scratch, stored

#: Vectors of a block, about, and pivots at most: what tasks hold beside their rows.
BLOCK, MOST_PIVOTS = 4_096, 1_024
#: Of more vectors than MANY blocks are larger instead of more, up to LARGEST vectors (68 MB of 64 components): each vector is shipped
#: to no more of them than of few, so that what is shipped grows as the vectors do.
MANY, BLOCKS, LARGEST = 32_768, 8, 131_072
#: Vectors that ask one block in one task, and cosines that a task holds at once.
ASKING, AT_ONCE = 65_536, 1_048_576
#: What rounding may take from a distance.
SLACK = 1e-6


def block_size(count: int) -> int:
    return BLOCK if count <= MANY else max(BLOCK, min(LARGEST, -(-count // BLOCKS)))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 1)


def units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    v = matrix(column)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def apart(cosine: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def may_be_best(c: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of c that hold, among others, the n largest of each row, and what rounding may put in their place.

    n of a row's entries reach the n-th largest of the maxima of its parts of ``width``; parts below that are not looked at again.
    """
    most = c.reshape(len(c), -1, width).max(2)
    bound = np.partition(most, most.shape[1] - n, axis=1)[:, most.shape[1] - n] - 1e-11
    i, part = np.nonzero(most >= bound[:, None])
    i, j = np.repeat(i, width), (part[:, None] * width + np.arange(width)).ravel()
    near = c[i, j] >= bound[i]
    return i[near], j[near]


def best_of(keys: np.ndarray, x: np.ndarray, other_keys: np.ndarray, y: np.ndarray, k: int) -> pd.DataFrame:
    """Of each of x the k of y with the highest cosine, ties by key, itself left out.

    The cosine is rounded to 12 places before ranking, so that the order of a sum does not decide a tie.
    """
    order, out = np.argsort(other_keys, kind="stable"), [pd.DataFrame({"key": keys[:0], "other": other_keys[:0], "cosine": np.zeros(0)})]
    other_keys, y = other_keys[order], y[order]
    n, count, step = min(k, len(y)), len(y), max(1, AT_ONCE // max(1, len(y)))
    width = max(1, min(64, count // (4 * max(1, n))))
    y = np.concatenate([y, np.zeros((-count % width, y.shape[1]))])
    for at in range(0, len(x) if n else 0, step):
        c, own = x[at : at + step] @ y.T, keys[at : at + step]
        c[:, count:] = -np.inf
        low, high = np.searchsorted(other_keys, own, "left"), np.searchsorted(other_keys, own, "right")
        for i in np.flatnonzero(low < high).tolist():
            c[i, low[i] : high[i]] = -np.inf
        # Only what may be among the best is rounded and ranked.
        i, j = may_be_best(c, n, width)
        cosine = np.round(c[i, j], 12)
        by = np.lexsort((j, -cosine, i))
        i, j, cosine = i[by], j[by], cosine[by]
        first = np.arange(len(i)) - np.searchsorted(i, i) < n
        first &= cosine > -np.inf
        out.append(pd.DataFrame({"key": own[i[first]], "other": other_keys[j[first]], "cosine": cosine[first]}))
    return pd.concat(out)


FOUND = "key long, other long, cosine double"


def alone(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The neighbours of vectors that are one block."""
    t = [b for b in batches if b.num_rows]
    if t:
        keys = np.concatenate([b.column("key").to_numpy() for b in t])
        x = np.concatenate([units(b.column("v")) for b in t])
        found = best_of(keys, x, keys, x, k)
        found["rank"] = (found.groupby("key").cumcount() + 1).astype(np.int32)
        yield pa.RecordBatch.from_pandas(found, preserve_index=False)


def celled(vectors: DataFrame, count: int) -> tuple[DataFrame, np.ndarray]:
    """vectors as unit vectors with the cell (nearest pivot) and the distance to it; and the pivots, by hashed keys.

    Vectors without length are in a cell of their own, -1: they are as far from all others as unlike ones are, which is no distance.
    """
    pivots = min(MOST_PIVOTS, max(1, -(-count // block_size(count))))
    some = vectors.filter(F.exists("v", lambda c: c != 0)).orderBy(F.xxhash64("key"), "key").limit(pivots).toPandas()["v"]
    p = np.stack(some.to_numpy()) if len(some) else np.zeros((0, 1))
    p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(batch.column("v"))
            length = np.linalg.norm(x, axis=1) > 0.5
            cell, d = np.full(len(x), -1), np.zeros(len(x))
            if length.any():
                c = x[length] @ p.T
                cell[length], d[length] = c.argmax(1), apart(c.max(1))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())), pa.array(cell.astype(np.int32)), pa.array(d)], ["key", "v", "cell", "d"])

    return vectors.select("key", "v").mapInArrow(run, "key long, v array<double>, cell int, d double"), p


def routed(rows: DataFrame, bounds: DataFrame, cells: list[tuple[int, float, int]], pivots: np.ndarray) -> DataFrame:
    """rows (key, v, cell, part) to each other block (to_cell, to_part) that may hold a nearer vector than their bound.

    By the triangle inequality a block whose cell's pivot is further away than the bound and the cell's radius holds none.
    """
    number, radius, parts = (np.array(c) for c in zip(*cells, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(batch.column("v"))
            own, part, bound = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "bound"))
            bound = np.where(np.isnan(bound.astype(float)), np.inf, bound.astype(float))
            to_row, to_cell, to_part = [], [], []
            for c, r, n in zip(number.tolist(), radius.tolist(), parts.tolist(), strict=True):
                near = np.full(len(x), True) if c == -1 else (apart(x @ pivots[c]) - r <= bound + SLACK) | (own == -1)
                for j in range(n):
                    rows_ = np.flatnonzero(near & ~((own == c) & (part == j)))
                    to_row.append(rows_)
                    to_cell.append(np.full(len(rows_), c, np.int32))
                    to_part.append(np.full(len(rows_), j, np.int32))
            at = np.concatenate(to_row)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(np.concatenate(to_cell)), pa.array(np.concatenate(to_part))], ["key", "v", "to_cell", "to_part"])

    return rows.join(bounds, "key", "left").select("key", "v", "cell", "part", "bound").mapInArrow(run, "key long, v array<double>, to_cell int, to_part int")


def nearest(vectors: DataFrame, k: int = 1) -> DataFrame:
    """vectors (key, v): of each the k others with the highest cosine, ties by key: key, rank, other, cosine.

    Vectors are dealt to the cells of pivots, large cells in parts.  Each finds its k best in its own block; that bounds
    how far away a better one can be, and it is shipped to those blocks only that may hold one.
    """
    count = vectors.count()
    if count <= BLOCK:  # one block, without cells
        return vectors.select("key", "v").coalesce(1).mapInArrow(lambda batches: alone(batches, k), FOUND + ", rank int")
    dealt, pivots = celled(vectors, count)
    with Scratch(vectors.sparkSession) as scratch:
        rows = scratch.stored(dealt, "celled")
        sizes = rows.groupBy("cell").agg(F.max("d").alias("radius"), F.ceil(F.count("*") / block_size(count)).cast("int").alias("parts"))
        cells = [tuple(r) for r in sizes.orderBy("cell").collect()]  # MOST_PIVOTS and one
        if not cells:
            return vectors.sparkSession.createDataFrame([], "key long, other long, cosine double, rank int")
        parts = F.element_at(F.create_map(*[F.lit(x) for c, _, n in cells for x in (c, n)]), F.col("cell"))
        rows = rows.select("key", "v", "cell", F.pmod(F.xxhash64("key"), parts).cast("int").alias("part"))

        def inside(t: pa.Table) -> pa.Table:
            keys, x = t.column("key").to_numpy(), matrix(t.column("v"))
            return pa.Table.from_pandas(best_of(keys, x, keys, x, k), preserve_index=False)

        def across(a: pa.Table, b: pa.Table) -> pa.Table:
            best = best_of(a.column("key").to_numpy(), matrix(a.column("v")), b.column("key").to_numpy(), matrix(b.column("v")), k)
            return pa.Table.from_pandas(best, preserve_index=False)

        own = stored(rows.groupBy("cell", "part").applyInArrow(inside, FOUND), "own")
        found = own
        if sum(n for *_, n in cells) > 1:
            bound = F.when(F.count("*") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("cosine"))))
            queries = routed(rows, own.groupBy("key").agg(bound.alias("bound")), cells, pivots)
            # However many ask a block, no task has more than ASKING of them, about.
            shares = -(-count // ASKING)
            queries = queries.withColumn("share", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(shares)).cast("int"))
            asked = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
            found = own.unionByName(queries.groupBy("to_cell", "to_part", "share").cogroup(asked.groupBy("cell", "part", "share")).applyInArrow(across, FOUND))
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("cosine"), "other"))).filter(F.col("rank") <= k)
        return stored(found, "nearest")


def scored(nearest_one: DataFrame, labels: DataFrame, frequent: int) -> DataFrame:
    """Agreement of each vector's label with its neighbour's: over all, and over labels that stand often enough."""
    own, other = labels.select("key", "label"), labels.select(F.col("key").alias("other"), F.col("label").alias("found"))
    hits = nearest_one.join(own, "key").join(other, "other").select("label", (F.col("label") == F.col("found")).cast("int").alias("hit"))
    by = hits.groupBy("label").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    often = F.col("n") >= frequent
    return by.agg(
        F.sum("n").alias("vectors"), F.sum("hits").alias("hits"), F.round(F.sum("hits") / F.sum("n"), 6).alias("micro"), F.count_if(often).alias("frequent_labels"),
        F.round(F.avg(F.when(often, F.col("hits") / F.col("n"))), 6).alias("macro_frequent"), F.round(F.sum(F.when(often, F.col("hits"))) / F.sum(F.when(often, F.col("n"))), 6).alias("micro_frequent"), F.count_if(F.col("n") == 1).alias("singletons"),
    )


def within(vectors: DataFrame, radius: float) -> DataFrame:
    """vectors (key, v): edges u, v that join the same vectors as all pairs at a distance within the radius do.

    All blocks of keys meet in pairs; of the pairs of two blocks a task keeps a spanning forest only.
    """
    nearly = 1 - radius * radius / 2 - 1e-11

    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        key, block, v = t.column("key").to_numpy(), t.column("block").to_numpy(), units(t.column("v"))
        label = np.arange(len(v))
        first, second = (np.flatnonzero(block == t.column(c)[0].as_py()) for c in ("bi", "bj"))
        y = v[second]
        step = max(1, AT_ONCE // max(1, len(second)))
        for at in range(0, len(first), step):
            c = v[first[at : at + step]] @ y.T
            i, j = np.nonzero(c >= nearly)
            a, b = label[first[i + at]], label[second[j]]
            open_ = np.flatnonzero(a != b)
            open_ = open_[np.sqrt(np.maximum(0.0, 2 - 2 * np.round(c[i[open_], j[open_]], 12))) <= radius]
            if len(open_):
                label = forest(len(v), a[open_], b[open_])[label]
        moved = np.flatnonzero(label != np.arange(len(v)))
        return pa.table({"u": key[moved], "v": key[label[moved]]})

    count = vectors.count()
    blocks = max(1, -(-count // block_size(count)))
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    met = vectors.select("key", "v", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    return met.select("key", "v", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")).groupBy("bi", "bj").applyInArrow(joined, "u long, v long")


def density_clusters(vectors: DataFrame, min_samples: int, radius: float, min_cluster_size: int) -> DataFrame:
    """One cut of the density hierarchy: key, cluster_id (smallest key; -1 is noise), core_distance.

    The core distance of a vector is the distance to its ``min_samples``-th neighbour.  Vectors whose core
    distance is within the radius are joined with all others as dense as themselves at a mutual
    reachability within the radius; components of enough vectors are clusters.
    """
    near = stored(nearest(vectors, min_samples).withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine")))), "near")
    core = near.groupBy("key").agg(F.max("distance").alias("core_distance"))
    dense = stored(vectors.join(core.filter(F.col("core_distance") <= radius), "key", "left_semi").select("key", "v"), "dense")
    joined = components(within(dense, radius)).withColumnRenamed("node", "key")
    found = dense.select("key").join(joined, "key", "left").select(F.col("key").alias("node"), F.coalesce("component", "key").alias("component"))
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= min_cluster_size)
    members = found.join(sizes, "component").select(F.col("node").alias("key"), F.col("component").alias("cluster_id"))
    rows = vectors.select("key").join(core, "key", "left").join(members, "key", "left")
    return rows.select("key", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.round("core_distance", 6).alias("core_distance"))
