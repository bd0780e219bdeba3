"""Label runs laid over each other, and what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_unique(rows: DataFrame, key: str) -> None:
    """Fails if a key stands twice."""
    twice = rows.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]!r} stands {twice[0][1]} times")


def overlay(base: DataFrame, over: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """All rows, those of ``over`` where it has the key, with outcome: kept, replaced, changed or appended.

    A replaced row counts as changed where a compared column differs.  The schemas must agree.
    """
    if base.columns != over.columns:
        raise ValueError(f"columns differ: {base.columns} and {over.columns}")
    b, o = base.alias("b"), over.alias("o")
    both = b.join(o, F.col(f"b.{key}") == F.col(f"o.{key}"), "full")
    there, new = F.col(f"b.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"o.{c}"))
    outcome = F.when(~new, "kept").when(~there, "appended").when(same, "replaced").otherwise("changed")
    return both.select(*[F.when(new, F.col(f"o.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in base.columns], outcome.alias("outcome"))


def stale_buckets(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """rows (key, stem, kept, label): what may be wrong with labels that a run left in place.

    A: another row of the stem (the one with the smallest key) has the kept label; B: the run's own
    label is in the vocabulary (column ``label``); C: neither.
    """
    # The two smallest keys of each label of a stem: one of them is another row's.
    lower = rows.select("key", F.col("stem").alias("_stem"), F.lower("label").alias("_l"))
    smallest = lower.groupBy("_stem", "_l").agg(F.min("key").alias("one"))
    second = lower.join(smallest, ["_stem", "_l"]).filter("key <> one").groupBy("_stem", "_l").agg(F.min("key").alias("two"))
    smallest = smallest.join(second, ["_stem", "_l"], "left")
    kept = rows.filter("kept IS NOT NULL").select("key", "stem", "kept")
    twins = kept.join(smallest, (F.col("stem") == F.col("_stem")) & (F.lower("kept") == F.col("_l")))
    twin = twins.select("key", F.when(F.col("one") != F.col("key"), F.col("one")).otherwise(F.col("two")).alias("twin")).filter("twin IS NOT NULL")
    known = vocabulary.select(F.col("label").alias("_known")).distinct()
    marked = rows.filter("kept IS NOT NULL").join(twin, "key", "left").join(known, F.col("label") == F.col("_known"), "left")
    bucket = F.when(F.col("twin").isNotNull(), "A").when(F.col("_known").isNotNull(), "B").otherwise("C")
    return marked.select("key", "kept", "label", "twin", bucket.alias("bucket"))


def decide(rows: DataFrame, explicit: DataFrame, recheck: DataFrame) -> DataFrame:
    """rows (key, bucket) with decision: given explicitly, else by bucket (A take, else keep); a recheck holds for C only."""
    default = F.when(F.col("bucket") == "A", "take").otherwise("keep")
    joined = rows.join(explicit.select("key", F.col("decision").alias("_said")), "key", "left").join(recheck.select("key", F.col("decision").alias("_again")), "key", "left")
    decision = F.when((F.col("bucket") == "C") & F.col("_again").isNotNull(), F.col("_again")).otherwise(F.coalesce("_said", default))
    return joined.select(*rows.columns, decision.alias("decision"))


def compare_trees(left: DataFrame, right: DataFrame, keywords: Column) -> DataFrame:
    """Each row (path, content) of left against right: identical, keywords-differ, keywords-intact-other-differs, not-in-reference or unparseable.

    ``keywords`` is the part of a content that matters, as an expression over ``content``; it is null where that cannot be read, which
    makes a pair of different contents unparseable.
    """
    a = left.select("path", F.md5("content").alias("digest"), keywords.alias("kept"))
    b = right.select("path", F.md5("content").alias("r_digest"), keywords.alias("r_kept"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "not-in-reference").when(F.col("digest").eqNullSafe(F.col("r_digest")), "identical").when(F.col("kept").isNull() | F.col("r_kept").isNull(), "unparseable").when(F.col("kept") == F.col("r_kept"), "keywords-intact-other-differs").otherwise("keywords-differ")
    return a.join(b, "path", "left").select("path", status.alias("status"))


def apply_decisions(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows (key, applied) with applied = written where decided (key, decision) says take; other rows stay as they are."""
    take = decided.filter("decision = 'take'").select("key", F.lit(True).alias("_take")).distinct()
    return rows.join(take, "key", "left").withColumn("applied", F.when(F.col("_take"), "written").otherwise(F.col("applied"))).drop("_take")


def attach_last(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (key) with the label of the last of their label rows (key, position, label); null without any."""
    last = labels.groupBy("key").agg(F.max_by("label", "position").alias("label"))
    return rows.join(last, "key", "left")
