"""Which sidecar an image belongs to: by exact stem, else by the longest stem that it extends with -segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.functions.names import stem_bases


def claim(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """images (folder, stem) with base: the stem of the sidecar of the same folder that they claim, or null."""
    bases = images.select("folder", "stem", F.posexplode(stem_bases(F.col("stem"))).alias("dropped", "base"))
    found = bases.join(sidecars.select("folder", F.col("stem").alias("base")).distinct(), ["folder", "base"])
    longest = found.groupBy("folder", "stem").agg(F.min_by("base", "dropped").alias("base"))
    return images.join(longest, ["folder", "stem"], "left")


def own(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Claims, with owns: whether an image is the first of its sidecar's claimants."""
    first = W.partitionBy("folder", "base").orderBy("stem")
    return claim(images, sidecars).withColumn("owns", F.when(F.col("base").isNotNull(), F.row_number().over(first) == 1).otherwise(F.lit(False)))


def unreached(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars that no image claims."""
    taken = claim(images, sidecars).filter("base IS NOT NULL").select("folder", F.col("base").alias("stem"))
    return sidecars.join(taken, ["folder", "stem"], "left_anti")


def derivations(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Images without a sidecar of their own stem that a sidecar without an image of its own takes: folder, jpg, stem."""
    stems, jpgs = sidecars.select("folder", "stem").distinct(), images.select("folder", "stem").distinct()
    open_ = stems.join(jpgs, ["folder", "stem"], "left_anti")
    free = jpgs.join(stems, ["folder", "stem"], "left_anti")
    reach = free.select("folder", F.col("stem").alias("jpg"), F.explode(stem_bases(F.col("stem"))).alias("stem")).join(open_, ["folder", "stem"])
    return reach.groupBy("folder", "jpg").agg(F.max_by("stem", F.length("stem")).alias("stem"))


def resolve(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Each sidecar's verdict and images: ok (same stem), derived, no_jpg, or no_folder, with n_images.

    A free image goes to the longest sidecar without an image of its own stem that it extends.
    """
    stems, jpgs = sidecars.select("folder", "stem").distinct(), images.select("folder", "stem").distinct()
    exact = stems.join(jpgs, ["folder", "stem"], "left_semi")
    open_ = stems.join(jpgs, ["folder", "stem"], "left_anti")
    derived = derivations(images, sidecars).groupBy("folder", "stem").agg(F.count("*").alias("n"))
    folders = jpgs.select("folder", F.lit(True).alias("has_folder")).distinct()
    rest = open_.join(derived, ["folder", "stem"], "left").join(folders, "folder", "left")
    verdict = F.when(F.col("n").isNotNull(), "derived").when(F.col("has_folder"), "no_jpg").otherwise("no_folder")
    return exact.select("folder", "stem", F.lit("ok").alias("verdict"), F.lit(1).cast("long").alias("n_images")).unionByName(rest.select("folder", "stem", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).cast("long").alias("n_images")))


def extras(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Images that resolve gives to no sidecar: derived, with the longest sidecar that they extend, or orphan."""
    taken = derivations(images, sidecars).select("folder", F.col("jpg").alias("stem"))
    free = images.join(sidecars, ["folder", "stem"], "left_anti").join(taken, ["folder", "stem"], "left_anti").select("folder", "stem")
    return claim(free, sidecars).select("folder", "stem", F.when(F.col("base").isNull(), "orphan").otherwise("derived").alias("kind"), F.col("base").alias("parent"))


def multi_claims(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars with more than one claimant: their number, the keeper, and whether an exact stem wins."""
    claimed = claim(images, sidecars).filter("base IS NOT NULL")
    groups = claimed.groupBy("folder", "base").agg(F.count("*").alias("claimants"), F.min("stem").alias("keeper"), F.bool_or(F.col("stem") == F.col("base")).alias("exact_match_wins"))
    return groups.filter("claimants > 1")


def tree_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys (folder, stem) that only one of two trees has."""
    keys = ["folder", "stem"]
    only = lambda a, b, side: a.join(b, keys, "left_anti").select(*keys, F.lit(side).alias("side")).distinct()
    return only(left, right, "left").unionByName(only(right, left, "right"))


def folder_differences(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Folders that one tree alone has: orphan ones of images, unexported ones of sidecars."""
    a, b = images.select("folder").distinct(), sidecars.select("folder").distinct()
    only = lambda x, y, kind: x.join(y, "folder", "left_anti").select("folder", F.lit(kind).alias("kind"))
    return only(a, b, "orphan").unionByName(only(b, a, "unexported"))


# Fixed value: the reason of a sidecar that no report speaks of.
UNREPORTED = "(not mentioned by the exporter)"


def missing(images: DataFrame, sidecars: DataFrame, entries: DataFrame) -> DataFrame:
    """Sidecars without an image, with the reason and the raw's name of the first entry (folder, stem, pos, reason, name) of a report.

    Those that no report speaks of come first, then by folder and stem.
    """
    first = entries.groupBy("folder", "stem").agg(F.min(F.struct("pos", "reason", "name")).alias("x"))
    rows = resolve(images, sidecars).filter(F.col("verdict").isin("no_jpg", "no_folder")).join(first, ["folder", "stem"], "left")
    found = rows.select(F.coalesce("x.reason", F.lit(UNREPORTED)).alias("reason"), "verdict", "folder", "stem", F.coalesce("x.name", F.lit("")).alias("raw_name"))
    return found.orderBy(F.col("reason") != UNREPORTED, "folder", "stem")


def unprocessed(images: DataFrame, sidecars: DataFrame, categories: Column) -> DataFrame:
    """Sidecars (folder, stem, keywords) that carry no label: those whose image is there first, then by folder and stem.

    ``categories`` is the list of a sidecar's categories, as an expression; a sidecar that cannot be read (keywords is null) is not among
    them.  Columns: jpg_available, reason, folder, stem, verdict, copies (images that are its own).
    """
    open_ = sidecars.filter(F.col("keywords").isNotNull() & ((F.size("keywords") == 0) | (F.size(categories) == 0)))
    reason = F.when(F.size("keywords") == 0, "no keywords").otherwise("keywords but no category")
    rows = open_.select("folder", "stem", reason.alias("reason")).join(resolve(images, sidecars), ["folder", "stem"])
    found = rows.select((F.col("n_images") > 0).alias("jpg_available"), "reason", "folder", "stem", "verdict", F.col("n_images").alias("copies"))
    return found.orderBy(~F.col("jpg_available"), "folder", "stem")


def existing(named: DataFrame, tree: DataFrame, *key: str) -> DataFrame:
    """named rows whose key the tree has, and - as the column missing of each - how many of all it has not."""
    there = tree.select(*key).distinct().withColumn("_there", F.lit(1))
    rows = named.join(there, list(key), "left")
    lost = rows.agg(F.count_if(F.col("_there").isNull()).alias("missing"))
    return rows.filter("_there = 1").drop("_there").join(F.broadcast(lost))  # one row
