"""How clusters lie: tiles of the similarity matrix, radii, steps along an order, and slots on a calendar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.functions.vectors import distance, dot, normalised
from larkspar.operators.clusters import centroids
from larkspar.operators.order import neighbour, numbered, orbit
from larkspar.operators.spectral import PLACES, clipped_order
from larkspar.storage import stored


def tile_matrix(vectors: DataFrame, tiles: int) -> DataFrame:
    """vectors (position from 1, v): mean dot product of each pair of tiles (equal parts of the order).

    The mean over a tile is the dot product of the tiles' mean vectors; the n x n matrix is never made.
    """
    n = vectors.count()
    tile = F.least(F.floor((F.col("position") - 1) * tiles / n), F.lit(tiles - 1)).cast("long")
    means = centroids(vectors.select(tile.alias("cluster"), "v"))
    a, b = means.toDF("tile_a", "a"), means.toDF("tile_b", "b")
    return a.join(b, F.col("tile_a") <= F.col("tile_b")).select("tile_a", "tile_b", F.round(dot(F.col("a"), F.col("b")), 6).alias("mean_similarity"))  # tiles x tiles rows


def tile_starts(spark: SparkSession, n: int, tiles: int, warp: float = 1.0) -> DataFrame:
    """The first position (from 0) of each tile of n rows: all alike, or with a warp below 1 finer towards the end.

    Tiles that would begin at one position are one tile.
    """
    if warp >= 1:
        return spark.range(0, n, max(1, -(-n // tiles))).select(F.col("id").alias("start"))
    at = F.bround(F.lit(float(n)) * F.pow(F.col("id") / tiles, F.lit(warp)), 0).cast("long")
    return spark.range(0, tiles + 1).select(F.least(at, F.lit(n)).alias("start")).filter(F.col("start") < n).distinct()


def cluster_tile_starts(spans: DataFrame, tiles: int, warp: float) -> DataFrame:
    """spans (begin, end) of clusters: tile starts, each cluster's number of tiles in proportion to its size to the power of warp.

    A cluster has one tile at least and no more than it has rows; no tile holds rows of two clusters.
    """
    size = F.col("end") - F.col("begin")
    total = spans.agg(F.sum(F.pow(size, F.lit(warp))).alias("total"))
    per = F.greatest(F.lit(1), F.least(F.bround(F.pow(size, F.lit(warp)) / F.col("total") * tiles, 0).cast("long"), size))
    parts = spans.join(F.broadcast(total)).select("begin", size.alias("size"), per.alias("per"))  # one row
    return parts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("per") - 1))).select((F.col("begin") + F.floor(F.col("i") * F.col("size") / F.col("per"))).alias("start"))


def radii(vectors: DataFrame) -> DataFrame:
    """vectors (cluster, key, v) with radius (distance to the centroid), rank in the cluster and share of it within."""
    r = vectors.join(centroids(vectors), "cluster").select("cluster", "key", F.round(distance(F.col("v"), F.col("centroid")), 9).alias("radius"))
    line = numbered(r, "_at", "cluster", "radius", "key")
    begins = line.groupBy("cluster").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    return line.join(begins, "cluster").select("cluster", "key", "radius", (F.col("_at") - F.col("_first") + 1).cast("int").alias("rank"), "n")


def profile(ranked: DataFrame) -> DataFrame:
    """Per cluster: effective dimension (slope of log rank by log radius from the 0.1 to the 0.9 quantile), area below the share within by the share of the largest radius, and shape."""
    lo, hi = F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)), F.greatest(F.lit(2), F.floor(F.col("n") * 0.9))
    inside = F.col("rank").between(lo + 1, hi) & (F.col("radius") > 0)
    slope = F.regr_slope(F.when(inside, F.log(F.col("rank") / F.col("n"))), F.when(inside, F.log("radius")))
    far = ranked.groupBy("cluster").agg(F.max("radius").alias("far"))
    at = ranked.join(far, "cluster").select("cluster", "rank", "n", "radius", (F.col("radius") / F.nullif(F.col("far"), F.lit(0.0))).alias("x"), (F.col("rank") / F.col("n")).alias("y"))
    before = at.select("cluster", (F.col("rank") + 1).alias("rank"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    steps = at.join(before, ["cluster", "rank"], "left").withColumn("part", (F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0")) / 2)
    out = steps.groupBy("cluster").agg(F.max("n").alias("n"), F.round(slope, 6).alias("dimension"), F.round(F.sum("part"), 6).alias("auc"))
    return out.withColumn("shape", F.when(F.col("auc") > 0.5, "concave").otherwise("convex"))


def steps(vectors: DataFrame, gram: bool = False) -> DataFrame:
    """vectors (position, cluster, key, v): distance to the next in order, and whether the cluster changes there.

    cos_gap is 1 - dot; row_gap, on request, the distance of the two rows of the similarity matrix, by way of the
    sum of outer products.
    """
    pairs = neighbour(vectors, "position", ["cluster", "v"]).filter("next_v IS NOT NULL")
    out = pairs.select("position", "key", "cluster", (1 - dot(F.col("v"), F.col("next_v"))).alias("gap"), (F.col("cluster") != F.col("next_cluster")).cast("int").alias("boundary"), "v", "next_v")
    if gram:
        matrix = gram_rows(vectors).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda p: p["row"]).alias("gram"))
        delta = F.zip_with("next_v", "v", lambda x, y: x - y)
        out = out.withColumn("delta", delta).join(F.broadcast(matrix))  # dimension x dimension numbers
        out = out.withColumn("gap", F.sqrt(F.greatest(F.lit(0.0), dot(F.col("delta"), F.transform("gram", lambda r: dot(r, F.col("delta")))))))
    return out.select("position", "key", "cluster", F.round("gap", 6).alias("gap"), "boundary")


def gram_rows(vectors: DataFrame) -> DataFrame:
    """The sum of the vectors' outer products by rows (i, row): each task sends one matrix."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = vectors.select("v").mapInArrow(products, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    return sums.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda p: p["x"]).alias("row"))


def boundary_steps(gaps: DataFrame) -> DataFrame:
    """Mean step at cluster boundaries and elsewhere, and how many of the k largest steps are boundaries (k of them exist)."""
    k = gaps.agg(F.coalesce(F.sum("boundary"), F.lit(0))).first()[0]
    hits = gaps.orderBy(F.desc("gap"), "position").limit(k).agg(F.coalesce(F.sum("boundary"), F.lit(0)).alias("largest_that_are_boundaries"))
    means = gaps.agg(F.sum("boundary").alias("boundaries"), F.round(F.avg(F.when(F.col("boundary") == 1, F.col("gap"))), 6).alias("at_boundaries"), F.round(F.avg(F.when(F.col("boundary") == 0, F.col("gap"))), 6).alias("elsewhere"))
    return means.join(hits)


def rolling_median(rows: DataFrame, value: str, least: int = 200, part: int = 50_000) -> DataFrame:
    """rows (position from 1, value) with the median of the values around them; null for no more than ``least`` rows.

    The window is the 200th part of the rows, five at least: half of it before, the row and the rest behind it; beyond the
    ends the first and the last value go on.  Ranges of positions are dealt with what their windows reach into; of windows
    wider than a range see ``wide_medians``.
    """
    n = rows.count()
    if n <= least:
        return rows.withColumn("median", F.lit(None).cast("double"))
    k = max(5, n // 200)
    before, after = k // 2, k - k // 2 - 1
    if k > part:
        return rows.join(wide_medians(rows.select(F.col("position").cast("long").alias("position"), F.col(value).cast("double").alias("value")), n, k, part), "position")

    def medians(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("position", ignore_index=True)
        x = t["value"].to_numpy()
        x = np.concatenate([np.repeat(x[0], before if t["position"][0] == 1 else 0), x, np.repeat(x[-1], after if t["position"].iloc[-1] == n else 0)])
        first = t["position"][0] + (0 if t["position"][0] == 1 else before)
        m = pd.Series(x).rolling(k).median().to_numpy()[k - 1 :]
        found = pd.DataFrame({"position": np.arange(first, first + len(m)), "median": m})
        return found[(found["position"] - 1) // part == t["part"][0]]

    p = F.col("position") - 1
    reach = F.sequence(F.floor(F.greatest(p - after, F.lit(0)) / part), F.floor(F.least(p + before, F.lit(n - 1)) / part))
    dealt = rows.select(F.col("position").cast("long").alias("position"), F.col(value).cast("double").alias("value"), F.explode(reach).alias("part"))
    found = dealt.groupBy("part").applyInPandas(medians, "position long, median double")
    return rows.join(found, "position")


def wide_medians(rows: DataFrame, n: int, k: int, part: int) -> DataFrame:
    """rows (position from 1 to n, value) with the median of windows of k > part rows: position, median.  Tasks hold some parts, whatever k is.

    All windows of a part have most of their rows, whole parts, in common.  Of these only those can be a median whose rank
    there is near the middle: they lie in few of the buckets that the order of values is cut into.  Counts by part and bucket tell which,
    and how many rows are below; with them and the rows that enter and leave, a task slides along its part.
    """
    before, after = k // 2, k - k // 2 - 1
    parts = -(-n // part)
    spark = rows.sparkSession
    line = numbered(rows, "_order", "value", "position")
    line = stored(line.select("position", "value", F.floor((F.col("_order") - 1) / part).alias("bucket"), F.floor((F.col("position") - 1) / part).alias("of")), "line")
    ends = line.filter(F.col("position").isin(1, n)).orderBy("position").collect()  # two rows
    (first, first_bucket), (last, last_bucket) = ((r["value"], r["bucket"]) for r in (ends[0], ends[-1]))

    # Of part p, rows a to b: whole parts q1 to q2 are in all windows, parts reach_from to reach_to in some; left and right: how often
    # the first and the last value go on in all windows.
    p = F.col("p")
    a, b = p * part + 1, F.least((p + 1) * part, F.lit(n))
    q1 = F.greatest(F.lit(0), F.ceil((b - before - 1) / part))
    q2 = F.when(a + after >= n, F.lit(parts - 1)).otherwise(F.floor((a + after) / part) - 1)
    plan = spark.range(parts).toDF("p").select("p", q1.alias("q1"), F.greatest(q2, q1 - 1).alias("q2"), F.floor(F.greatest(F.lit(0), a - before - 1) / part).alias("reach_from"), F.floor((F.least(F.lit(n), b + after) - 1) / part).alias("reach_to"), F.greatest(F.lit(0), before - (b - 1)).alias("left"), F.greatest(F.lit(0), after - (n - a)).alias("right"))
    plan = stored(plan, "plan")
    shared = plan.filter("q2 >= q1").select("p", F.explode(F.sequence("q1", "q2")).alias("of")).groupBy("of").agg(F.min("p").alias("begin"), F.max("p").alias("end"))
    cells = line.groupBy("of", "bucket").agg(F.count("*").alias("c")).join(shared, "of")
    events = cells.select(F.col("begin").alias("p"), "bucket", "c").unionByName(cells.select((F.col("end") + 1).alias("p"), "bucket", (-F.col("c")).alias("c"))).groupBy("p", "bucket").agg(F.sum("c").alias("c"))
    grid = spark.range(parts * parts).select((F.col("id") % parts).alias("p"), F.floor(F.col("id") / parts).alias("bucket"))
    common = grid.join(events, ["p", "bucket"], "left").withColumn("c", F.sum(F.coalesce("c", F.lit(0))).over(W.partitionBy("bucket").orderBy("p")))  # a row for each part
    going_on = plan.select("p", F.lit(first_bucket).alias("bucket"), F.col("left").alias("c")).unionByName(plan.select("p", F.lit(last_bucket).alias("bucket"), F.col("right").alias("c")))
    common = common.unionByName(going_on).groupBy("p", "bucket").agg(F.sum("c").alias("c")).filter("c > 0")
    upto = F.sum("c").over(W.partitionBy("p").orderBy("bucket"))
    inner = common.withColumn("upto", upto).join(common.groupBy("p").agg(F.sum("c").alias("core")), "p")
    near = stored(inner.filter((F.col("upto") > (k - 1) // 2 - (k - F.col("core"))) & (F.col("upto") - F.col("c") <= k // 2)), "near")
    below = near.groupBy("p").agg(F.min(F.col("upto") - F.col("c")).alias("below"))

    among = near.select("p", "bucket").join(plan.filter("q2 >= q1").select("p", F.explode(F.sequence("q1", "q2")).alias("of")), "p")
    candidates = line.join(among, ["of", "bucket"]).select("p", F.lit(None).cast("long").alias("position"), "value", F.lit(1).cast("long").alias("c"))
    constant = near.join(plan, "p").select("p", F.lit(None).cast("long").alias("position"), F.explode(F.array(F.struct(F.lit(first).alias("value"), F.when(F.col("bucket") == first_bucket, F.col("left")).otherwise(0).alias("c")), F.struct(F.lit(last).alias("value"), F.when(F.col("bucket") == last_bucket, F.col("right")).otherwise(0).alias("c")))).alias("x")).select("p", "position", "x.value", "x.c").filter("c > 0")
    edges = line.join(plan.select("p", F.explode(F.filter(F.sequence("reach_from", "reach_to"), lambda q: (q < F.col("q1")) | (q > F.col("q2")))).alias("of")), "of").select("p", "position", "value", F.lit(1).cast("long").alias("c"))
    dealt = candidates.unionByName(constant).unionByName(edges).join(below, "p", "left").withColumn("below", F.coalesce("below", F.lit(0)))

    def slide(t: pd.DataFrame) -> pd.DataFrame:
        here = int(t["p"].iloc[0])
        a, b = here * part + 1, min((here + 1) * part, n)
        names, place = np.unique(np.append(t["value"].to_numpy(), [first, last]), return_inverse=True)
        tree, top = [0] * (len(names) + 1), 1 << (len(names).bit_length() - 1)

        def add(i: int, c: int) -> None:
            i += 1
            while i < len(tree):
                tree[i] += c
                i += i & -i

        def at(rank: int) -> float:
            i, step = 0, top
            while step:
                if i + step < len(tree) and tree[i + step] <= rank:
                    i += step
                    rank -= tree[i]
                step >>= 1
            return names[i]

        known = t["position"].notna().to_numpy()
        for i, c in zip(place[:-2][~known].tolist(), t["c"][~known].tolist(), strict=True):
            add(i, c)
        edge = dict(zip(t["position"][known].astype("int64").tolist(), place[:-2][known].tolist(), strict=True))
        for x, i in edge.items():
            if a - before <= x <= a + after:
                add(i, 1)
        add(int(place[-2]), max(0, before - (a - 1)) - max(0, before - (b - 1)))
        low, out = int(t["below"].iloc[0]), []
        for i in range(a, b + 1):
            if i > a:
                for x, c in ((i - 1 - before, -1), (i + after, 1)):
                    if x < 1:
                        add(int(place[-2]), c)
                    elif x > n:
                        add(int(place[-1]), c)
                    elif x in edge:
                        add(edge[x], c)
            out.append((at((k - 1) // 2 - low) + at(k // 2 - low)) / 2)
        return pd.DataFrame({"position": np.arange(a, b + 1), "median": out})

    return dealt.groupBy("p").applyInPandas(slide, "position long, median double")


def date_slots(groups: DataFrame, per_day: int = 1_440) -> DataFrame:
    """groups (position, size): the day on which each begins, when each takes whole days of so many slots."""
    days = groups.withColumn("days", F.greatest(F.lit(1), F.ceil(F.col("size") / per_day)).cast("long"))
    return running(days, "days", "before").select("position", "size", "days", F.col("before").alias("first_day"))


def member_slots(members: DataFrame, slots: DataFrame, per_day: int = 1_440) -> DataFrame:
    """members (position of their group, rank in it from 1, and others) with the day and the minute that they fall on.

    slots: see date_slots; a group's members follow each other minute by minute, over as many days as it takes.
    """
    k = F.col("rank") - 1
    return members.join(slots.select("position", "first_day"), "position").withColumns({"day": (F.col("first_day") + F.floor(k / per_day)).cast("long"), "minute": (k % per_day).cast("int")}).drop("first_day")


def running(rows: DataFrame, value: str, name: str, part: int = 50_000) -> DataFrame:
    """rows (position) with the sum of the values at smaller positions, in parts of the positions and over the parts."""
    parts = rows.withColumn("_part", F.floor(F.col("position") / part))
    totals = parts.groupBy("_part").agg(F.sum(value).alias("_t"))
    line = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each 50,000
    totals = totals.withColumn("_before", F.coalesce(F.sum("_t").over(line), F.lit(0))).drop("_t")
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_part").orderBy("position").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.join(totals, "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before")


# The colours that groups of one bin alternate in.
COLOURS = ("Red", "Blue")


def next_fit(groups: DataFrame, capacity: int) -> DataFrame:
    """groups (position from 1, without gaps; size) packed in order into bins: position, size, bin (from 1), offset in it, colour.

    A group goes to the open bin if it fits, else to a new one.  A group above the capacity begins an empty bin, fills as
    many as it needs, and leaves the last one open.  Where what begins with an empty bin ends is known for every
    group at once, and the begins are what is reached from the first.
    """
    sums = running(groups.withColumn("size", F.col("size").cast("long")), "size", "before").withColumn("upto", F.col("before") + F.col("size"))
    # The first group that no longer fits after a begin at s, with the bins that s itself fills: s + 1 at least.
    filled = F.when(F.col("size") > capacity, F.floor(F.col("size") / capacity)).otherwise(0)
    begins = sums.select("position", (F.col("before") + capacity * (filled + 1)).alias("value"), F.lit(1).alias("ask"), F.lit(None).cast("long").alias("end"))
    ends = sums.select(F.lit(None).cast("long").alias("position"), F.col("upto").alias("value"), F.lit(0).alias("ask"), F.col("position").alias("end"))
    line = numbered(begins.unionByName(ends), "line", "value", "ask", "end", "position")
    # The next end in line: all ends behind an asking row have a larger sum.
    found = next_known(line, "line", "end").filter("ask = 1")
    jumps = found.select(F.lit(0).alias("group"), F.col("position").alias("at"), F.when(F.col("found").isNotNull(), F.greatest("found", F.col("position") + 1)).alias("next"))
    first = groups.agg(F.min("position").alias("at")).select(F.lit(0).alias("group"), "at").filter("at IS NOT NULL")
    last = groups.agg(F.max("position")).first()[0]
    jumps = stored(jumps.filter(F.col("next") <= F.lit(last)), "jumps")
    heads = stored(orbit(jumps, first).select(F.col("at").alias("position"), F.lit(1).alias("head")), "heads")
    # What a begin fills until the next one does so much to the bins' numbers there.
    at = sums.select(F.col("position").alias("at"), F.col("before").alias("low"))
    to = sums.select(F.col("position").alias("next"), F.col("before").alias("high"))
    full = jumps.join(heads.select(F.col("position").alias("at")), "at").join(at, "at").join(to, "next").select(F.col("next").alias("position"), F.ceil((F.col("high") - F.col("low")) / capacity).alias("more"))
    marked = sums.join(heads, "position", "left").join(full, "position", "left").fillna(0, ["head", "more"])
    in_run = running(running(marked, "head", "heads"), "more", "bins").withColumn("run", F.col("heads") + F.col("head"))
    base = in_run.filter("head = 1").select("run", F.col("before").alias("base"), (F.col("bins") + F.col("more") + 1).alias("bin"))
    inside = F.col("before") - F.col("base")
    return in_run.join(base, "run").select("position", "size", (F.col("bin") + F.floor(inside / capacity)).cast("long").alias("bin"), (inside % capacity).alias("offset"), F.when(F.col("position") % 2 == 1, COLOURS[0]).otherwise(COLOURS[1]).alias("colour"))


def next_known(rows: DataFrame, line: str, value: str, part: int = 50_000) -> DataFrame:
    """rows with ``found``: the first value that is not null in line behind them, in parts and over the parts.

    Frames run backwards from the end: one that shrinks towards its end is read anew for each row.
    """
    parts = rows.withColumn("_part", F.floor(F.col(line) / part))
    heads = parts.filter(F.col(value).isNotNull()).groupBy("_part").agg(F.min_by(value, line).alias("_head"))
    all_parts = parts.select("_part").distinct().join(heads, "_part", "left")
    after = W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)  # one row for each 50,000
    all_parts = all_parts.withColumn("_after", F.last("_head", ignorenulls=True).over(after)).drop("_head")
    inside = F.last(value, ignorenulls=True).over(W.partitionBy("_part").orderBy(F.desc(line)).rowsBetween(W.unboundedPreceding, -1))
    return parts.join(all_parts, "_part").withColumn("found", F.coalesce(inside, F.col("_after"))).drop("_part", "_after")


#: Clusters whose similarities, a dense matrix, one task decomposes; of more the same is found by blocks.
FEW_CLUSTERS = 2_000


def spectral_order(vectors: DataFrame) -> DataFrame:
    """Clusters in the order of the second eigenvector of their centroids' similarity: cluster, place (from 1).

    The similarity of centroids is clipped at zero and has no diagonal; the eigenvector's sign is such that
    the smallest cluster's entry is not positive.
    """
    centres = stored(centroids(vectors), "centroids")
    if centres.count() > FEW_CLUSTERS:
        unit = normalised(F.col("centroid"))
        return clipped_order(centres.select(F.col("cluster").alias("key"), unit.alias("v"))).select(F.col("key").alias("cluster"), F.col("place").cast("int").alias("place"))

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"cluster": [], "centroid": []}), *(b for b in batches if len(b))]).sort_values("cluster", ignore_index=True)
        n = len(rows)
        if n >= 3:
            c = np.stack(rows["centroid"].to_numpy())
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
            w = np.clip(c @ c.T, 0, None)
            np.fill_diagonal(w, 0)
            second = np.linalg.eigh(np.diag(w.sum(1)) - w)[1][:, 1]
            even = np.round((second if second[0] <= 0 else -second) / np.abs(second).max(), PLACES)
            rows = rows.iloc[np.argsort(even, kind="stable")]
        yield pd.DataFrame({"cluster": rows["cluster"].astype("int64"), "place": np.arange(1, n + 1)})

    return centres.coalesce(1).mapInPandas(ordered, "cluster long, place int")


def display_order(vectors: DataFrame, least: int) -> DataFrame:
    """vectors (cluster, key, v) as they are shown: clusters in spectral order, members from the core outwards.

    Columns: cluster, place (of the cluster), key, rank (in it), kept (whether it has ``least`` members; others are the tail, in the
    same order).
    """
    return radii(vectors).join(spectral_order(vectors), "cluster").select("cluster", "place", "key", "rank", (F.col("n") >= least).alias("kept"))
