"""Clusters of vectors: sizes, centres, and how they agree with labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.functions.vectors import distance, dot, norm
from larkspar.operators.order import numbered

#: Vectors of one block; two blocks meet in one task.
BLOCK = 2_048


def blocks_of(vectors: DataFrame, cluster: str, key: str) -> tuple[DataFrame, DataFrame]:
    """vectors dealt to all pairs (bi, bj) of the blocks of their cluster: once as first, once as second."""
    sizes = vectors.groupBy(cluster).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    dealt = vectors.join(sizes, cluster).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    first = dealt.withColumnsRenamed({"_own": "bi", "_other": "bj"}).drop("_blocks")
    second = dealt.withColumnsRenamed({"_own": "bj", "_other": "bi"}).drop("_blocks")
    return first, second.toDF(*second.columns)


def distance_sums(vectors: DataFrame) -> DataFrame:
    """vectors (cluster, key, v: unit length) with the sum of their distances to all of their cluster."""

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"cluster": [], "key": [], "s": []})
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        return pd.DataFrame({"cluster": a["cluster"], "key": a["key"], "s": np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T))).sum(1)})

    a, b = blocks_of(vectors, "cluster", "key")
    parts = a.groupBy("cluster", "bi", "bj").cogroup(b.groupBy("cluster", "bi", "bj")).applyInPandas(sums, "cluster long, key long, s double")
    return parts.groupBy("cluster", "key").agg(F.sum("s").alias("s"))


def centroids(vectors: DataFrame) -> DataFrame:
    """The mean vector of each cluster, not normalised."""
    means = vectors.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy("cluster").agg(F.transform(ordered, lambda p: p["m"]).alias("centroid"))


def report(vectors: DataFrame) -> DataFrame:
    """Per cluster: size, medoid (least sum of distances, ties by key), centroid_norm, centroid_medoid_gap."""
    best = distance_sums(vectors).groupBy("cluster").agg(F.count("*").alias("size"), F.min_by("key", F.struct(F.round("s", 6), "key")).alias("medoid"))
    medoid = vectors.select(F.col("cluster").alias("_c"), F.col("key").alias("_k"), F.col("v").alias("_v"))
    joined = best.join(centroids(vectors), "cluster").join(medoid, (F.col("cluster") == F.col("_c")) & (F.col("medoid") == F.col("_k")))
    return joined.select("cluster", "size", "medoid", F.round(norm(F.col("centroid")), 6).alias("centroid_norm"), F.round(distance(F.col("_v"), F.col("centroid")), 6).alias("centroid_medoid_gap"))


def sized(rows: DataFrame, cluster: str, noise: int) -> DataFrame:
    """rows with the size of their cluster, none for noise."""
    sizes = rows.filter(F.col(cluster) != noise).groupBy(cluster).agg(F.count("*").alias("cluster_size"))
    return rows.join(sizes, cluster, "left")


def agreement(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """How labels fall on clusters: labelled clusters, pure ones, mean share of the dominant label, labels in several."""
    pairs = rows.filter(F.coalesce(F.col(label), F.lit("")) != "").groupBy(cluster, label).agg(F.count("*").alias("n"))
    by_cluster = pairs.groupBy(cluster).agg(F.count("*").alias("labels"), (F.max("n") / F.sum("n")).alias("share"))
    by_label = pairs.groupBy(label).agg(F.count("*").alias("clusters"))
    a = by_cluster.agg(F.count("*").alias("clusters_labelled"), F.count_if(F.col("labels") == 1).alias("single_label_clusters"), F.round(F.avg("share"), 6).alias("mean_dominant_share"))
    return a.join(by_label.agg(F.count("*").alias("labels_seen"), F.count_if(F.col("clusters") > 1).alias("labels_split")))


def dominant(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """The most common label of each cluster (ties by name), its share, and the cluster's rows."""
    pairs = rows.filter(F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count("*").alias("n"))
    found = pairs.groupBy(cluster).agg(F.sum("n").alias("rows"), F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), label)).alias("x"))
    return found.select(cluster, "rows", F.col(f"x.{label}").alias("dominant"), F.round(F.col("x.n") / F.col("rows"), 6).alias("purity"))


def summary(rows: DataFrame, cluster: str, noise: int) -> DataFrame:
    """Clusters, rows, noise and its share, the ten largest sizes, and the median size without its fraction."""
    sizes = rows.filter(F.col(cluster) != noise).groupBy(cluster).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n")).limit(10).agg(F.array_join(F.transform(F.sort_array(F.collect_list("n"), asc=False), lambda x: x.cast("string")), ",").alias("largest"))
    a = sizes.agg(F.count("*").alias("clusters"), F.floor(F.percentile("n", F.lit(0.5))).alias("median_size"))
    b = rows.agg(F.count("*").alias("rows"), F.count_if(F.col(cluster) == noise).alias("noise"), F.round(F.count_if(F.col(cluster) == noise) / F.count("*"), 4).alias("noise_fraction"))
    return a.join(b).join(top)


def homogeneity(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """Homogeneity, completeness and their harmonic mean, from the contingency of clusters and labels."""
    table = rows.filter(F.col(cluster).isNotNull() & F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count("*").alias("n"))
    total = table.agg(F.sum("n").alias("t"))
    by_c, by_l = (table.groupBy(c).agg(F.sum("n").alias(s)) for c, s in ((cluster, "nc"), (label, "nl")))
    h = lambda counts, n: counts.join(F.broadcast(total)).agg((-F.sum(F.col(n) / F.col("t") * F.log(F.col(n) / F.col("t")))).alias(f"h_{n}"))  # noqa: E731  one row is broadcast
    both = table.join(by_c, cluster).join(by_l, label).join(F.broadcast(total))
    given = both.agg((-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("nc")))).alias("h_l_c"), (-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("nl")))).alias("h_c_l"))
    x = given.join(h(by_l, "nl")).join(h(by_c, "nc"))
    hom = F.when(F.col("h_nl") == 0, 1.0).otherwise(1 - F.col("h_l_c") / F.col("h_nl"))
    com = F.when(F.col("h_nc") == 0, 1.0).otherwise(1 - F.col("h_c_l") / F.col("h_nc"))
    x = x.select(hom.alias("hom"), com.alias("com"))
    v = F.when(F.col("hom") + F.col("com") == 0, 0.0).otherwise(2 * F.col("hom") * F.col("com") / (F.col("hom") + F.col("com")))
    return x.select(F.round("hom", 6).alias("homogeneity"), F.round("com", 6).alias("completeness"), F.round(v, 6).alias("v_measure"))


def pair_similarity(vectors: DataFrame) -> DataFrame:
    """Mean cosine of pairs with the same and with different clusters, from the sums of vectors alone."""
    sums = vectors.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
    squares = sums.groupBy("cluster").agg(F.sum(F.col("x") * F.col("x")).alias("sq"))
    own = vectors.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(dot(F.col("v"), F.col("v"))).alias("o"))
    same = squares.join(own, "cluster").agg(F.sum(F.col("sq") - F.col("o")).alias("same_sum"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same_pairs"), F.sum("o").alias("o"), F.sum("n").alias("n"))
    whole = sums.groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("all_sq"))
    x = same.join(whole)
    pairs = F.col("n") * (F.col("n") - 1)
    return x.select((F.col("same_pairs") / 2).cast("long").alias("same_pairs"), F.round(F.col("same_sum") / F.col("same_pairs"), 6).alias("same_cosine"), ((pairs - F.col("same_pairs")) / 2).cast("long").alias("different_pairs"), F.round((F.col("all_sq") - F.col("o") - F.col("same_sum")) / (pairs - F.col("same_pairs")), 6).alias("different_cosine"))


def frequent_only(rows: DataFrame, label: str, least: int) -> DataFrame:
    """rows whose label stands at least so often."""
    often = rows.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(label)
    return rows.join(often, label, "left_semi")


def density_peaks(rows: DataFrame) -> DataFrame:
    """rows (cluster, key, position, probability): of each cluster the member with the highest probability, the first of equal ones."""
    peak = F.max_by("key", F.struct("probability", -F.col("position")))
    return rows.groupBy("cluster").agg(peak.alias("density_peak"), F.round(F.avg("probability"), 6).alias("mean_probability"))


def spans(rows: DataFrame) -> DataFrame:
    """rows (position from 1, without gaps; cluster): runs of one cluster along the positions: begin, end (past the last), cluster.

    Rows meet by their positions in one way at every size: files of positions are so small that Spark would ship all rows whole.
    """
    before = rows.select((F.col("position") + 1).alias("position"), F.col("cluster").alias("_before"), F.lit(True).alias("_there"))
    heads = rows.join(before.hint("merge"), "position", "left").filter(F.col("_there").isNull() | ~F.col("cluster").eqNullSafe(F.col("_before"))).select("position", "cluster")
    heads = numbered(heads, "_n", "position")
    n = rows.agg(F.max("position").alias("_last"))
    after = heads.select((F.col("_n") - 1).alias("_n"), F.col("position").alias("_next"))
    return heads.join(after.hint("merge"), "_n", "left").join(F.broadcast(n)).select(F.col("position").alias("begin"), F.coalesce("_next", F.col("_last") + 1).alias("end"), "cluster")


def adjusted_mutual_information(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """How much clusters and labels agree beyond chance (AMI, with the mean of both entropies), and their mutual information.

    The chance term is a sum over pairs of sizes; clusters and labels of one size are taken together, so there are no more sizes
    than twice the root of the number of rows.
    """
    table = rows.filter(F.col(cluster).isNotNull() & F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count("*").alias("n"))
    total = table.agg(F.sum("n").alias("t"))
    a, b = (table.groupBy(c).agg(F.sum("n").alias(s)) for c, s in ((cluster, "a"), (label, "b")))
    both = table.join(a, cluster).join(b, label).join(F.broadcast(total))  # one row
    mutual = both.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    entropy = lambda sizes, c: sizes.join(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(f"h{c}"))
    sizes = lambda counts, c: counts.groupBy(c).agg(F.count("*").alias(f"m{c}"))

    def by_chance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, mx, y, my, t in batch[["a", "ma", "b", "mb", "t"]].itertuples(index=False):
                low, high = max(0, x + y - t), min(x, y)
                # Of the hypergeometric law only what is within 4.5 roots of the smaller size around the mean counts: by Hoeffding's bound
                # the rest is below 1e-17.  Terms follow from the mode outwards and are scaled to a sum of one.
                mode, reach = (x + 1) * (y + 1) // (t + 2), 4.5 * high**0.5 + 2
                n = np.arange(max(low, int(mode - reach)), min(high, int(mode + reach)) + 1, dtype="float64")
                step = np.log((x - n[:-1]) * (y - n[:-1])) - np.log(n[1:] * (t - x - y + n[1:]))
                p = np.r_[0.0, np.cumsum(step)]
                p = np.exp(p - p.max())
                p, n = (p / p.sum())[n > 0], n[n > 0]
                out.append(mx * my * float((n / t * np.log(n * (t / (x * y))) * p).sum()))
            yield pd.DataFrame({"part": out})

    pairs = sizes(a, "a").join(sizes(b, "b")).join(F.broadcast(total)).select("a", "ma", "b", "mb", "t")
    chance = pairs.mapInPandas(by_chance, "part double").agg(F.sum("part").alias("e"))
    x = mutual.join(chance).join(entropy(a, "a")).join(entropy(b, "b"))
    span = (F.col("ha") + F.col("hb")) / 2 - F.col("e")
    ami = F.when((F.col("ha") == 0) & (F.col("hb") == 0), 1.0).otherwise((F.col("mi") - F.col("e")) / F.when(F.abs(span) < 1e-12, 1e-12).otherwise(span))
    return x.select(F.round(ami, 6).alias("ami"), F.round("mi", 6).alias("mutual_information"))
