"""Density clusters at all scales: the hierarchy of mutual reachability, condensed, and partitions chosen from it.

Vectors may fall in groups, which are clustered apart; several least cluster sizes are done at once.  A *point* is a
vector at one of the sizes, and has a number: ``place * sizes + size``.  Distances are those of unit vectors.

1. Blocks of a group meet in pairs, once for all sizes.  Of the edges within a block, and of those between two, a minimum spanning
   forest is left only: an edge that is the heaviest of a cycle among these is so among all.  Boruvka rounds join the forests.
   Large groups have larger blocks, which meet tile by tile (see screened), so that what is shipped grows as the vectors do.
2. The dendrogram is found by halves: the lighter edges of a problem make components, each a problem of its own, and the
   heavier ones are a problem over these components.  Problems of at most FEW edges are solved by a walk along their edges.
3. Condensing asks of each merge only its parent, its sizes and its weight: who leaves a cluster, and when, is reached by
   doubling pointers.
4. Clusters are chosen by excess of mass, or as leaves; what the choice of a grid of sizes is judged by is read off the tree.

Weights are ordered by (weight, points), so that a spanning tree is one and the same for any dealing.  Equal vectors count as
CLOSEST apart.  A null group is a group.  Vectors without length are at the distance of unlike ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.operators.components import components
from larkspar.operators.neighbours import matrix
from larkspar.operators.order import numbered
from larkspar.operators.screened import Closest, Forests, prim, to_distances
from larkspar.storage import Scratch, passing, settings, shared_dir, stored

#: Vectors of a block; of large groups blocks are up to WIDER times as large, so that each vector is shipped to fewer.
BLOCK, WIDER = 1_024, 3
#: Of larger groups the blocks grow, up to LARGEST vectors (68 MB of 64 components), instead of becoming more than BLOCKS: what is shipped
#: grows as the vectors do.
BLOCKS, LARGEST = 20, 131_072
#: Blocks of no more vectors meet as whole matrices, larger ones tile by tile.
DENSE = 2_048
#: Tasks that pairs of blocks are dealt to, at most.
MOST_TASKS = 2_000
#: So many edges, merges or clusters are few MB: one task walks along them.
FEW = 100_000
CLOSEST = 1e-9
#: Numbers of points make small files of many rows: Spark would ship these whole, by way of the driver.
NOT_SHIPPED = {"spark.sql.autoBroadcastJoinThreshold": "-1"}


def shipped_if_few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW else rows


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of unit vectors; the cosine is rounded so that the order of a sum decides nothing."""
    return to_distances(x @ y.T)


def points(vectors: DataFrame) -> DataFrame:
    """vectors (group, key, v) with place (from 0), by group and key, and length; v is in single precision where that loses nothing."""
    single = F.transform("v", lambda c: c.cast("float"))
    exact = vectors.agg(F.bool_and(F.coalesce(F.forall("v", lambda c: c.cast("float").cast("double") == c), F.lit(False)))).first()[0]
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    rows = vectors.select("group", "key", (single if exact else F.col("v")).alias("v"), F.greatest(length, F.lit(1e-300)).alias("length"))
    return numbered(rows, "place", F.col("group").asc_nulls_first(), "key").withColumn("place", (F.col("place") - 1).cast("long"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """Each group's first place, which tells it from others, and its number of blocks."""
    n = F.count("*")
    size = F.greatest(F.lit(BLOCK), F.least(F.lit(WIDER * BLOCK), F.ceil(n / 8)), F.least(F.lit(LARGEST), F.ceil(n / BLOCKS)))
    return rows.groupBy(F.col("group").alias("_g")).agg(F.min("place").alias("first"), F.ceil(n / size).cast("int").alias("blocks"))


def paired(rows: DataFrame) -> DataFrame:
    """rows (group, place, and others) dealt to all pairs of blocks of their group: first, block, other, bi, bj, once to each."""
    dealt = rows.join(F.broadcast(blocks_of(rows)), F.col("group").eqNullSafe(F.col("_g"))).drop("_g").withColumn("block", F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("blocks")


def in_tasks(met: DataFrame, number: Column, tasks: int, *order: str) -> DataFrame:
    """met dealt to tasks by group and number, neighbouring numbers to different ones, each task's rows in the order."""
    tasks = max(1, min(MOST_TASKS, tasks))
    task = F.pmod(F.pmod("first", F.lit(tasks)) + number, F.lit(tasks)).cast("int")
    return met.repartitionById(tasks, task).sortWithinPartitions(*order)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Batches, cut where a key changes, with their keys."""
    for batch in batches:
        k = np.column_stack([batch.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for at, to in pairwise(cuts):
            if to > at:
                yield tuple(k[at].tolist()), batch.slice(at, to - at)


def units(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return matrix(rows.column("v")).astype(float) / rows.column("length").to_numpy()[:, None]


def arrays(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def core_distances(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Per place the distance to the size-th neighbour, for each size, or to the farthest of fewer: an array in order of sizes.

    A task has the vectors of a block, which come first, and is passed by all of the group.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groupby(runs(batches, ["first", "other", "own"]), key=lambda part: part[0][:2]):
            first, closest = [], None
            for (*_, own), batch in chain(parts, [((0, 0, 0), None)]):
                if own:
                    first.append(batch)
                    continue
                if closest is None:
                    t = pa.Table.from_batches(first)
                    x, place = units(t), t.column("place").to_numpy()
                    closest = Closest(x, place, max(sizes))
                    closest.meet(x, place)
                if batch is not None:
                    closest.meet(units(batch), batch.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(place), arrays(closest.distances(sizes))], ["place", "core"])

    met = paired(rows).select("first", "other", (F.col("block") == F.col("other")).cast("int").alias("own"), "place", "v", "length")
    tasks = blocks_of(rows).agg(F.sum("blocks")).first()[0] or 1
    return in_tasks(met, F.col("other"), tasks, "first", "other", F.desc("own")).mapInArrow(nearest, "place long, core array<double>")


def prim_between(weights: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Edges (i, j: ranks) of the minimum spanning tree of the edges between two sides: weights of each left one to each right one.

    rank: of the left ones, then of the right ones; of equal weights edges of smaller (least, greatest) ranks are taken.
    """
    left, n = len(weights), len(rank)
    back = np.ascontiguousarray(weights.T)
    # best is infinite for those in the tree, bound is less than any weight.
    best, bound, code = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n, np.int64)
    edges, j = np.zeros(n - 1, np.int64), 0
    for step in range(n - 1):
        best[j], bound[j] = np.inf, -np.inf
        row, first = (weights[j], left) if j < left else (back[j - left], 0)
        near = np.flatnonzero(row <= bound[first : first + len(row)])
        if len(near):
            w, at = row[near], near + first
            pair = np.minimum(rank[at], rank[j]) * n + np.maximum(rank[at], rank[j])
            better = (w < bound[at]) | (pair < code[at])
            at = at[better]
            best[at] = bound[at] = w[better]
            code[at] = pair[better]
        tied = np.flatnonzero(best == best.min())
        j = int(tied[code[tied].argmin()])
        edges[step] = code[j]
    return np.column_stack((edges // n, edges % n))


def full_trees(x: np.ndarray, core: np.ndarray, i: np.ndarray, j: np.ndarray, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size the tree of all edges between points i and j, or within i: ends (the smaller first) and weights."""
    d = distances(x[i], x[j])
    for s in range(core.shape[1] if min(len(i), len(j)) and len(x) > 1 else 0):
        reach = np.maximum(d, core[i, s][:, None])
        np.maximum(reach, core[j, s][None, :], out=reach)
        a, b = (prim(reach) if alone else prim_between(reach, np.r_[i, j])).T
        at = np.full(len(x), -1)
        at[i] = np.arange(len(i))
        own, other = (a, b) if alone else (np.where(at[a] >= 0, a, b), np.where(at[a] >= 0, b, a))
        yield a, b, np.maximum(np.maximum(core[a, s], core[b, s]), d[at[own], np.searchsorted(j, other)])


def screened_trees(x: np.ndarray, core: np.ndarray, i: np.ndarray, j: np.ndarray, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for large blocks, without those edges between i and j that edges within i or j tell to be the heaviest of a cycle."""
    if min(len(i), len(j)):
        forests = Forests(x, core)
        forests.meet(i, None if alone else j)
        side = np.zeros(len(x), bool)
        side[i] = True
        for a, b, w in forests.merge():
            kept = np.full(len(a), True) if alone else side[a] != side[b]
            yield a[kept], b[kept], w[kept]


def candidate_edges(rows: DataFrame, n_sizes: int) -> DataFrame:
    """rows (group, place, v, length, core): edges a, b (points), w that hold the minimum spanning trees of mutual reachability."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, bi, bj), parts in groupby(runs(batches, ["first", "bi", "bj"]), key=lambda part: part[0]):
            t = pa.Table.from_batches([batch for _, batch in parts]).sort_by("place")
            x, core, place, block = units(t), matrix(t.column("core")), t.column("place").to_numpy(), t.column("block").to_numpy()
            i, j = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
            found = full_trees if max(len(i), len(j)) <= DENSE else screened_trees
            for s, (a, b, w) in enumerate(found(x, core, i, j, bi == bj)):
                yield pa.RecordBatch.from_arrays([pa.array(place[a] * n_sizes + s), pa.array(place[b] * n_sizes + s), pa.array(w)], ["a", "b", "w"])

    met = paired(rows).select("first", "bi", "bj", "block", "place", "v", "length", "core")
    tasks = blocks_of(rows).agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2).cast("long")).first()[0] or 1
    number = F.col("bj") * (F.col("bj") + 1) / 2 + F.col("bi")
    return in_tasks(met, number.cast("long"), tasks, "first", "bi", "bj").mapInArrow(trees, "a long, b long, w double")


def root_of(label: dict[int, int], x: int) -> int:
    top = x
    while (up := label.get(top, top)) != top:
        top = up
    while (up := label.get(x, x)) != x:
        label[x], x = top, up
    return top


def kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kruskal's rule on few edges a, b, w between components u, v."""
    both = [b for b in batches if b.num_rows]
    if both:
        t = pa.Table.from_batches(both).sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")])
        label, keep = {}, []
        for i, (u, v) in enumerate(zip(t.column("u").to_pylist(), t.column("v").to_pylist(), strict=True)):
            u, v = root_of(label, u), root_of(label, v)
            if u != v:
                label[max(u, v)] = min(u, v)
                keep.append(i)
        yield from t.take(keep).select(["a", "b", "w"]).to_batches()


def spanning(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """The minimum spanning forest of edges (a, b, w): each round takes every component's lightest edge."""
    with Scratch(edges.sparkSession) as scratch:
        open_ = scratch.stored(edges.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v")), "open")
        found = None
        while True:
            if open_.count() <= FEW:
                # Of parallel edges of two components the first in the order of points stays.
                first = open_.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("w", "a", "b")).alias("x"))
                last = first.select("u", "v", "x.*").coalesce(1).mapInArrow(kruskal, "a long, b long, w double")
                return stored(last if found is None else found.unionByName(last), "tree", folder)
            way = F.struct("w", "a", "b", "u", "v")
            lightest = open_.select(F.col("u").alias("node"), way.alias("e")).unionByName(open_.select(F.col("v").alias("node"), way.alias("e"))).groupBy("node").agg(F.min("e").alias("e"))
            taken = scratch.stored(lightest.select("e.*").distinct(), "taken")
            found = taken.select("a", "b", "w") if found is None else found.unionByName(taken.select("a", "b", "w"))
            joined = components(taken.select("u", "v"))
            name = lambda c: (shipped_if_few(joined).select(F.col("node").alias(c), F.col("component").alias(f"new_{c}")), c)
            moved = open_.join(*name("u")).join(*name("v")).filter("new_u <> new_v").select("a", "b", "w", F.col("new_u").alias("u"), F.col("new_v").alias("v"))
            before, open_ = open_, scratch.stored(moved, "open")
            scratch.drop(before)


MERGE = "id long, w double, left long, right long, left_size long, right_size long"


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Problems (sorted by sub, id) walked along their edges: what each edge merges.

    left, right: a merge before it, or -1 - point.
    """
    sub, label, state = None, {}, {}
    for batch in batches:
        out = []
        for s, i, w, a, a_size, a_top, b, b_size, b_top in zip(*(batch.column(c).to_pylist() for c in ("sub", "id", "w", "a", "a_size", "a_top", "b", "b_size", "b_top")), strict=True):
            if s != sub:
                sub, label, state = s, {}, {}
            u, v = root_of(label, a), root_of(label, b)
            left, right = state.get(u, (a_size, a_top)), state.get(v, (b_size, b_top))
            label[max(u, v)] = min(u, v)
            state[min(u, v)] = (left[0] + right[0], i)
            out.append((i, w, left[1], right[1], left[0], right[0]))
        yield pa.RecordBatch.from_pylist([dict(zip(("id", "w", "left", "right", "left_size", "right_size"), r, strict=True)) for r in out], pa.schema([("id", pa.int64()), ("w", pa.float64()), *((c, pa.int64()) for c in ("left", "right", "left_size", "right_size"))]))


def dendrogram(tree: DataFrame) -> DataFrame:
    """The merges (id, w, left, right, left_size, right_size) of a spanning forest (a, b, w); ids are in the order of the edges."""
    with Scratch(tree.sparkSession) as scratch:
        edges = numbered(tree, "id", "w", "a", "b").withColumn("id", F.col("id").cast("long"))
        size, top = F.lit(1).cast("long"), lambda c: (-1 - F.col(c)).alias(f"{c}_top")
        edges = scratch.stored(edges.select("id", "w", "a", size.alias("a_size"), top("a"), "b", size.alias("b_size"), top("b"), F.lit(0).cast("long").alias("sub")), "edges")
        while True:
            counts = edges.groupBy("sub").agg(F.count("*").alias("n"), F.percentile_approx("id", 0.5).alias("middle")).filter(F.col("n") > FEW)
            large = scratch.stored(counts, "large")
            if large.isEmpty():
                break
            marked = scratch.stored(edges.join(F.broadcast(large), "sub", "left").withColumn("light", F.coalesce(F.col("id") <= F.col("middle"), F.lit(False))), "marked")  # every large problem has over FEW edges
            light = marked.filter("light")
            # A problem's nodes are told apart by it: nodes of other problems may have the same number.
            ends = light.select("sub", F.col("a").alias("node"), F.col("a_size").alias("size")).unionByName(light.select("sub", F.col("b").alias("node"), F.col("b_size").alias("size"))).distinct()
            nodes = scratch.stored(numbered(ends, "number", "sub", "node"), "nodes")
            named = lambda c: nodes.select("sub", F.col("node").alias(c), F.col("number").alias(f"{c}_number"))
            ends_named = scratch.stored(light.join(named("a"), ["sub", "a"]).join(named("b"), ["sub", "b"]), "light")
            joined = components(ends_named.select(F.col("a_number").alias("u"), F.col("b_number").alias("v"))).withColumnRenamed("node", "number")
            of_edge = ends_named.join(joined.withColumnRenamed("number", "a_number"), "a_number")
            tops = scratch.stored(of_edge.groupBy("component").agg(F.max("id").alias("top")), "tops")
            whole = nodes.join(joined, "number").groupBy("component").agg(F.sum("size").alias("size"), F.min("node").alias("name")).join(tops, "component")
            into = scratch.stored(nodes.select("sub", "node", "number").join(joined, "number").join(whole, "component").select("sub", "node", "name", "size", "top"), "into")
            parts = of_edge.join(shipped_if_few(tops), "component").select("id", "w", "a", "a_size", "a_top", "b", "b_size", "b_top", F.col("top").alias("sub"))
            heavy = marked.filter("NOT light").drop("light", "n", "middle")
            for c in ("a", "b"):
                moved = into.select("sub", F.col("node").alias(c), F.col("name").alias("_name"), F.col("size").alias("_size"), F.col("top").alias("_top"))
                heavy = heavy.join(moved, ["sub", c], "left").withColumns({c: F.coalesce("_name", c), f"{c}_size": F.coalesce("_size", f"{c}_size"), f"{c}_top": F.coalesce("_top", f"{c}_top")}).drop("_name", "_size", "_top")
            before, edges = edges, scratch.stored(parts.unionByName(heavy), "edges")
            for table in (before, large, marked, nodes, ends_named, tops, into):
                scratch.drop(table)
        dealt = edges.repartition("sub").sortWithinPartitions("sub", "id")
        return stored(dealt.mapInArrow(merged, MERGE), "merges")


def whole(batches: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    return pd.concat([pd.DataFrame(columns=columns), *(b for b in batches if len(b))])


def last_of(pointers: DataFrame) -> DataFrame:
    """pointers (id, next): where the way from each id ends (id, last); of many by doubling, of few by one task."""
    with Scratch(pointers.sparkSession) as scratch:
        ways = scratch.stored(pointers.select("id", "next"), "ways")
        if ways.count() <= FEW:

            def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                if len(t := whole(batches, ["id", "next"])):
                    known = t["next"].notna()
                    label = dict(zip(t["id"][known].tolist(), t["next"][known].astype("int64").tolist(), strict=True))
                    yield pd.DataFrame({"id": t["id"], "last": [root_of(label, x) for x in t["id"].tolist()]})

            return stored(ways.coalesce(1).mapInPandas(walked, "id long, last long"), "last")
        while True:
            ahead = ways.filter("next IS NOT NULL").select(F.col("id").alias("next"), F.col("next").alias("far"))
            longer = scratch.stored(ways.join(ahead, "next", "left"), "ways")
            if longer.filter("far IS NOT NULL").isEmpty():
                return stored(ways.select("id", F.coalesce("next", "id").alias("last")), "last")
            before, ways = ways, scratch.stored(longer.select("id", F.coalesce("far", "next").alias("next")), "ways")
            scratch.drop(before)
            scratch.drop(longer)


def density(w: Column) -> Column:
    return 1 / F.greatest(w, F.lit(CLOSEST))


def least_size(point: Column, sizes: list[int]) -> Column:
    return F.get(F.array(*map(F.lit, sizes)), F.pmod(point, F.lit(len(sizes))).cast("int"))


def condensed(merges: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """The condensed tree: leaving points (point, cluster, lambda), and clusters (cluster, parent, birth, size), the root's parent null.

    A cluster is named by the merge that makes it whole.  A merge splits if both sides have the least size; else its cluster goes
    on, and the points of a smaller side leave it at the merge's density.
    """
    with Scratch(merges.sparkSession) as scratch:
        sides = merges.select(F.col("id").alias("parent"), F.explode(F.array(F.struct(F.col("left").alias("id"), F.col("left_size").alias("size")), F.struct(F.col("right").alias("id"), F.col("right_size").alias("size")))).alias("c")).select("c.id", "c.size", "parent")
        sides = scratch.stored(sides, "sides")
        # Every merge is of one size: its tree's.  The tree's number comes from any point below it: the root of a merge's way up.
        roots = last_of(merges.select("id").join(sides.filter("id >= 0").select("id", F.col("parent").alias("next")), "id", "left"))
        of_root = sides.filter("id < 0").join(roots.withColumnRenamed("id", "parent"), "parent").groupBy("last").agg(F.min(least_size(-1 - F.col("id"), sizes)).alias("least"))
        up = sides.filter("id >= 0").select("id", "parent")
        nodes = merges.join(roots, "id").join(F.broadcast(of_root), "last").join(up, "id", "left")
        split = (F.col("left_size") >= F.col("least")) & (F.col("right_size") >= F.col("least"))
        nodes = scratch.stored(nodes.select("id", "parent", "w", "least", (F.col("left_size") + F.col("right_size")).alias("size"), split.alias("splits")), "nodes")
        above = nodes.select(F.col("id").alias("parent"), F.col("splits").alias("cut"), F.col("w").alias("parent_w"))
        large = scratch.stored(nodes.filter(F.col("size") >= F.col("least")).join(above, "parent", "left"), "large_nodes")
        # The cluster of a large merge: the first merge above it that a split, or nothing, stands above.
        heads = last_of(large.select("id", F.when(F.coalesce("cut", F.lit(True)), F.lit(None).cast("long")).otherwise(F.col("parent")).alias("next"))).withColumnRenamed("last", "cluster")
        # The first large merge above a point: it leaves there.
        small = nodes.filter(F.col("size") < F.col("least")).select("id", F.col("parent").alias("next"))
        ways = small.unionByName(large.select("id", F.lit(None).cast("long").alias("next"))).unionByName(sides.filter("id < 0").select("id", F.col("parent").alias("next")))
        ends = last_of(ways).filter("id < 0")
        leaving = ends.select((-1 - F.col("id")).alias("point"), F.col("last").alias("id")).join(large.select("id", "w"), "id").join(heads, "id").select("point", "cluster", density(F.col("w")).alias("lambda"))
        own = large.join(heads, "id").filter("id = cluster").select("cluster", F.col("parent").alias("at"), "size", "parent_w")
        parent = heads.select(F.col("id").alias("at"), F.col("cluster").alias("parent"))
        clusters = own.join(parent, "at", "left").select("cluster", "parent", F.coalesce(density(F.col("parent_w")), F.lit(0.0)).alias("birth"), "size")
        return stored(leaving, "leaving"), stored(clusters, "clusters")


def stabilities(leaving: DataFrame, clusters: DataFrame) -> DataFrame:
    """clusters with their stability and the largest density at which something leaves them."""
    gone = leaving.select("cluster", F.col("lambda").alias("at"), F.lit(1).cast("long").alias("size"))
    parts = clusters.filter("parent IS NOT NULL").select(F.col("parent").alias("cluster"), F.col("birth").alias("at"), "size")
    sums = gone.unionByName(parts).join(clusters.select("cluster", "birth"), "cluster").groupBy("cluster").agg(F.round(F.sum((F.col("at") - F.col("birth")) * F.col("size")), 6).alias("stability"), F.max("at").alias("most"))
    return clusters.join(sums, "cluster")


def worth_more(known: DataFrame) -> DataFrame:
    """Of clusters (cluster, parent, stability) those (cluster) that are worth as much as what can be chosen below them.

    Leaves go first, then those whose parts are all done, round by round; of few one task does all.
    """
    with Scratch(known.sparkSession) as scratch:
        open_ = scratch.stored(known.select("cluster", "parent", "stability", F.lit(0.0).alias("below")), "open")
        chosen = None
        while open_.count() > FEW:
            parts = open_.filter("parent IS NOT NULL").select(F.col("parent").alias("cluster")).distinct()
            done = open_.join(parts, "cluster", "left_anti").select("cluster", "parent", F.greatest("stability", "below").alias("worth"), (F.col("stability") >= F.col("below")).alias("own"))
            done = scratch.stored(done, "done")
            chosen = done.filter("own").select("cluster") if chosen is None else chosen.unionByName(done.filter("own").select("cluster"))
            given = done.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.sum("worth").alias("more"))
            left = open_.join(done, "cluster", "left_anti").join(given, "cluster", "left").select("cluster", "parent", "stability", F.round(F.col("below") + F.coalesce("more", F.lit(0.0)), 6).alias("below"))
            before, open_ = open_, scratch.stored(left, "open")
            scratch.drop(before)

        def upward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if len(t := whole(batches, ["cluster"])):
                t = t.sort_values("cluster")  # a merge has a larger number than those below it
                below = dict(zip(t["cluster"].tolist(), t["below"].tolist(), strict=True))
                out = []
                for c, p, s in zip(t["cluster"].tolist(), t["parent"].tolist(), t["stability"].tolist(), strict=True):
                    if s >= below[c]:
                        out.append(c)
                    if p == p and p is not None:
                        below[int(p)] = round(below[int(p)] + max(s, below[c]), 6)
                yield pd.DataFrame({"cluster": out})

        last = open_.coalesce(1).mapInPandas(upward, "cluster long")
        return stored(last if chosen is None else chosen.unionByName(last), "chosen")


def selected(known: DataFrame, selection: str) -> DataFrame:
    """For each cluster below or in a chosen one the chosen one (cluster, label): by excess of mass ("eom") or leaves ("leaf").

    The root is never chosen.
    """
    with Scratch(known.sparkSession) as scratch:
        inner = known.filter("parent IS NOT NULL")
        parts = inner.select(F.col("parent").alias("cluster")).distinct()
        best = inner.join(parts, "cluster", "left_anti").select("cluster") if selection == "leaf" else worth_more(known).join(inner, "cluster", "left_semi").select("cluster")
        best = scratch.stored(best.withColumn("own", F.lit(True)), "best")
        # The nearest chosen one above, or itself; and of chosen ones the topmost.
        ways = known.join(best, "cluster", "left").select(F.col("cluster").alias("id"), F.when(F.col("own"), F.lit(None).cast("long")).otherwise(F.col("parent")).alias("next"))
        near = last_of(ways).join(best.withColumnRenamed("cluster", "last"), "last", "left_semi")
        up = best.join(known, "cluster").select(F.col("cluster").alias("id"), F.col("parent").alias("over"))
        next_ = up.join(near.select(F.col("id").alias("over"), F.col("last").alias("next")), "over", "left").select("id", "next")
        top = last_of(next_)
        return stored(near.join(top.select(F.col("id").alias("last"), F.col("last").alias("label")), "last").select(F.col("id").alias("cluster"), "label"), "selected")


def clustered(vectors: DataFrame, sizes: list[int], selection: str = "eom") -> tuple[DataFrame, DataFrame]:
    """vectors (group, key, v) at each least size, and the spanning tree.

    Rows: group, key, least, point, label (a number that a cluster's members share; null is noise), probability.  Edges: a, b, w.
    """
    n, spark = len(sizes), vectors.sparkSession
    folder = shared_dir(spark)  # what is not stored there goes with the block
    with passing(spark), Scratch(spark) as scratch, settings(spark, NOT_SHIPPED):
        rows = scratch.stored(points(vectors), "points")
        cores = scratch.stored(core_distances(rows, sizes), "cores")
        tree = spanning(candidate_edges(rows.join(cores, "place"), n), folder)
        leaving, clusters = condensed(dendrogram(tree), sizes)
        known = scratch.stored(stabilities(leaving, clusters), "known")
        labels = selected(known, selection)
        member = leaving.join(labels, "cluster").join(known.select(F.col("cluster").alias("label"), "most"), "label")
        member = member.select("point", "label", F.least(F.lit(1.0), F.col("lambda") / F.col("most")).alias("probability"))
        each = rows.select("group", "key", F.explode(F.array(*[F.struct((F.col("place") * n + i).alias("point"), F.lit(s).alias("least")) for i, s in enumerate(sizes)])).alias("p"))
        out = each.select("group", "key", "p.point", "p.least").join(member, "point", "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
        return stored(out, "clustered", folder), tree


def sweep(vectors: DataFrame, sizes: list[int], selection: str = "eom") -> DataFrame:
    """vectors (key, v) clustered at each least size: key, min_cluster_size, cluster_id, probability.

    Clusters are numbered from 0 in the order of their smallest keys; -1 is noise, with probability 0.
    """
    found, _ = clustered(vectors.select(F.lit(0).alias("group"), "key", "v"), sizes, selection)
    first = found.filter("label IS NOT NULL").groupBy("least", "label").agg(F.min("key").alias("first"))
    ids = first.withColumn("cluster_id", (F.row_number().over(W.partitionBy("least").orderBy("first")) - 1).cast("long"))  # few rows: each is a cluster
    return found.join(ids, ["least", "label"], "left").select("key", F.col("least").alias("min_cluster_size"), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "probability")


def validity(found: DataFrame, tree: DataFrame) -> DataFrame:
    """How well each group's clusters at each size are set apart (group, least, score): see clustered for the arguments.

    A cluster's sparseness is its longest tree edge inside, its separation the shortest edge to another cluster (twice the longest of
    all, if it has none); scores are weighted by size, noise counting as nothing.
    """
    of = lambda c: found.select(F.col("point").alias(c), F.col("label").alias(f"{c}_label"), *([F.col("group"), F.col("least")] if c == "a" else []))
    edges = tree.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
    longest = edges.groupBy("group", "least").agg(F.max("w").alias("longest"))
    same = F.col("a_label") == F.col("b_label")
    each = edges.filter("a_label IS NOT NULL AND b_label IS NOT NULL").select("group", "least", "w", same.alias("same"), F.explode(F.array_distinct(F.array("a_label", "b_label"))).alias("label"))
    by = each.groupBy("group", "least", "label").agg(F.coalesce(F.max(F.when(F.col("same"), F.col("w"))), F.lit(0.0)).alias("inside"), F.min(F.when(~F.col("same"), F.col("w"))).alias("apart"))
    keys = ["group", "least"]
    sizes = found.groupBy(*keys).agg(F.count("*").alias("n"))
    members = found.filter("label IS NOT NULL").groupBy(*keys, "label").agg(F.count("*").alias("size"))
    on = lambda x, *more: [F.col("l.group").eqNullSafe(F.col(f"{x}.group")), F.col("l.least") == F.col(f"{x}.least"), *more]
    rows = members.alias("l").join(by.alias("e"), on("e", F.col("l.label") == F.col("e.label")), "left").join(longest.alias("g"), on("g")).join(sizes.alias("s"), on("s"))
    inside, apart = F.coalesce("e.inside", F.lit(0.0)), F.coalesce("e.apart", 2 * F.col("g.longest"))
    index = F.coalesce((apart - inside) / F.nullif(F.greatest(apart, inside), F.lit(0.0)), F.lit(0.0))
    return rows.select(F.col("l.group").alias("group"), F.col("l.least").alias("least"), (F.col("l.size") * index / F.col("s.n")).alias("part")).groupBy(*keys).agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("clusters"))


def subdivided(vectors: DataFrame, grid: list[int], selection: str = "leaf") -> DataFrame:
    """Each cluster of vectors (cluster, key, v) clustered anew: cluster, key, least, fine, strict.

    Of the grid's sizes with at least two parts (and twice the size in the cluster) the one of the best validity is taken, of
    equal ones the first.  Parts are named cluster.number, numbered from 0 in the order of their smallest keys; what
    is in no part keeps the cluster's name in fine and has none in strict.  A cluster that is not split keeps its name in both.
    """
    rows = vectors.select(F.col("cluster").alias("group"), "key", "v")
    found, tree = clustered(rows, grid, selection)
    sizes = rows.groupBy(F.col("group").alias("_g")).agg(F.count("*").alias("all"))
    scores = validity(found, tree).filter("clusters >= 2").join(sizes, F.col("group").eqNullSafe(F.col("_g"))).filter(F.col("least") * 2 <= F.col("all"))
    place = F.array_position(F.array(*map(F.lit, grid)), F.col("least"))
    taken = scores.groupBy(F.col("group").alias("_g")).agg(F.max_by("least", F.struct("score", -place)).alias("taken"))
    first = found.filter("label IS NOT NULL").groupBy("group", "least", "label").agg(F.min("key").alias("first"))
    parts = first.withColumn("part", (F.row_number().over(W.partitionBy("group", "least").orderBy("first")) - 1)).select(F.col("group").alias("_pg"), "least", "label", "part")  # few rows: each is a part
    once = found.select("group", "key", "least", "label").join(taken, F.col("group").eqNullSafe(F.col("_g")), "left").filter(F.coalesce(F.col("taken"), F.lit(grid[0])) == F.col("least"))
    named = once.join(parts, F.col("group").eqNullSafe(F.col("_pg")) & (once["least"] == parts["least"]) & (once["label"] == parts["label"]), "left")
    name = F.col("group").cast("string")
    part = F.when(F.col("taken").isNotNull() & F.col("part").isNotNull(), F.concat_ws(".", name, F.col("part").cast("string")))
    return named.select(F.col("group").alias("cluster"), "key", F.col("taken").alias("min_cluster_size"), F.coalesce(part, name).alias("fine"), F.when(F.col("taken").isNull(), name).otherwise(part).alias("strict"))
