"""Captures that exist more than once, and trips whose dates do not fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of_capture(rows: DataFrame, capture: str, key: str) -> DataFrame:
    """One row of each capture: the one with the smallest key. An empty capture is the row's own."""
    own = F.coalesce(F.nullif(F.trim(F.col(capture)), F.lit("")), F.col(key).cast("string"))
    keyed = rows.withColumn("_capture", own)
    least = keyed.groupBy("_capture").agg(F.min(key).alias("_least"))
    same = [keyed["_capture"] == least["_capture"], keyed[key] == least["_least"]]
    return keyed.join(least, same, "left_semi").drop("_capture")


def capture_key(original_id: Column, captured: Column, frame: Column, raw_name: Column) -> Column:
    """What tells a capture: the original document's id, else its time and frame, else its time and the raw's name; null without time.

    The id outlives new names and times; an empty text counts as absent.
    """
    known = lambda c: F.nullif(c, F.lit(""))
    named = F.coalesce(raw_name, F.lit(""))
    by_frame = F.concat_ws("|", F.lit("time+frame"), captured, frame["code"], frame["num"])
    by_name = F.concat_ws("|", F.lit("time+name"), captured, named)
    dated = known(captured).isNotNull()
    return F.when(known(original_id).isNotNull(), F.concat(F.lit("odid|"), original_id)).when(dated & frame.isNotNull(), by_frame).when(dated, by_name)


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """rows (capture, trip, is_copy, key, days_off) of captures found more than once, with kind, role and rank.

    Captures in more than one trip are cross-trip; within one, copies made on purpose are told apart.
    The row that stays comes first: originals, then the nearest to its trip's date, then by key.
    """
    groups = rows.filter("capture IS NOT NULL").groupBy("capture").agg(F.count("*").alias("group_size"), F.count_distinct("trip").alias("_trips"), F.bool_or("is_copy").alias("_copies"))
    kind = F.when(F.col("_trips") > 1, "cross-trip").when(F.col("_copies"), "virtual-copy").otherwise("within-trip")
    groups = groups.filter("group_size > 1").select("capture", "group_size", kind.alias("kind"))
    order = W.partitionBy("capture").orderBy("is_copy", F.coalesce("days_off", F.lit(1_000_000)), "key")
    ranked = rows.join(groups, "capture").withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("role", F.when(F.col("rank") == 1, "keep").otherwise("duplicate"))


def misplaced(rows: DataFrame, threshold: int = 2) -> DataFrame:
    """rows (trip, key, captured, days_off): trips whose date is wrong, and stray rows of trips whose date is right.

    Where more than half of a trip's dated rows are off, the trip is one result with the range of its
    captures; else each row that is off is one.
    """
    dated = rows.filter("days_off IS NOT NULL").withColumn("off", F.col("days_off") > threshold)
    trips = dated.groupBy("trip").agg(F.count("*").alias("usable"), F.count_if("off").alias("outliers"), F.min("captured").alias("first"), F.max("captured").alias("last"))
    wrong = trips.filter(F.col("outliers") * 2 > F.col("usable"))
    right = trips.filter((F.col("outliers") > 0) & (F.col("outliers") * 2 <= F.col("usable"))).select("trip")
    strays = dated.filter("off").join(right, "trip")
    return wrong.select(F.lit("trip").alias("kind"), "trip", F.lit(None).cast("long").alias("key"), "outliers", "first", "last").unionByName(
        strays.select(F.lit("stray").alias("kind"), "trip", "key", F.lit(1).cast("long").alias("outliers"), F.col("captured").alias("first"), F.col("captured").alias("last"))
    )


def self_agreement(rows: DataFrame, capture: str, *values: str) -> DataFrame:
    """How often captures that were exported more than once got the same values: captures, and for each value same_ and its share.

    A null value is a value; captures without a name (null) are not told apart and left out.
    """
    one = rows.filter(F.col(capture).isNotNull()).groupBy(capture).agg(F.count("*").alias("_n"), *[(F.count_distinct(v) + F.max(F.col(v).isNull().cast("int")) == 1).alias(v) for v in values]).filter("_n > 1")
    counts = [x for v in values for x in (F.count_if(v).alias(f"same_{v}"), F.round(F.count_if(v) / F.count("*"), 6).alias(f"share_{v}"))]
    return one.agg(F.count("*").alias("captures"), *counts)
