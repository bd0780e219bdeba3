"""Positions and jumps in a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.storage import Scratch, stored


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with their 1-based position in the order, which must be total.

    Rows are dealt in ranges of the order; a range's rows are numbered in it, after the sizes of the ranges before.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._range") < F.col("a._range"), "left").groupBy("a._range").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + inside).drop("_range", "_before")


def neighbour(rows: DataFrame, position: str, columns: list[str], ahead: int = 1) -> DataFrame:
    """rows with the columns of the row ``ahead`` positions further (null beyond the ends), by a join on the position.

    It is one join at every size: files of positions are so small that Spark would ship all rows whole.
    """
    other = rows.select((F.col(position) - ahead).alias(position), *[F.col(c).alias(f"next_{c}") for c in columns])
    return rows.join(other.hint("merge"), position, "left")


#: So many jumps are few MB: one task follows them.
FEW_JUMPS = 100_000


def orbit(jumps: DataFrame, starts: DataFrame) -> DataFrame:
    """All (group, at) reached from starts (group, at) by jumps (group, at, next), by doubling the jumps' length.

    A jump without next ends its way.  Takes as many rounds as the logarithm of the longest way; of no more than
    FEW_JUMPS jumps one task follows each way.
    """
    spark = jumps.sparkSession
    with Scratch(spark) as scratch:
        reached, jumps = scratch.stored(starts.select("group", "at"), "reached"), scratch.stored(jumps.select("group", "at", "next").filter("next IS NOT NULL"), "jumps")
        if jumps.count() <= FEW_JUMPS and reached.count() <= FEW_JUMPS:
            nothing = F.lit(None).cast(jumps.schema["next"].dataType)
            both = jumps.unionByName(reached.withColumn("next", nothing)).coalesce(1)
            return stored(both.mapInPandas(followed, reached.schema), "reached")
        while True:
            more = reached.join(jumps, ["group", "at"]).select("group", F.col("next").alias("at")).join(reached, ["group", "at"], "left_anti")
            more = scratch.stored(more, "more")
            if more.isEmpty():
                return stored(reached, "reached")
            longer = scratch.stored(reached.unionByName(more), "reached")
            far = jumps.select("group", F.col("at").alias("next"), F.col("next").alias("far"))
            further = scratch.stored(jumps.join(far, ["group", "next"]).select("group", "at", F.col("far").alias("next")), "jumps")
            for table in (reached, more, jumps):
                scratch.drop(table)
            reached, jumps = longer, further


def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches))
    ahead = rows[rows["next"].notna()]
    jumps = dict(zip(zip(ahead["group"], ahead["at"], strict=True), ahead["next"].astype("int64"), strict=True))
    found = set()
    for way in rows.loc[rows["next"].isna(), ["group", "at"]].itertuples(index=False):
        group, at = way
        while at is not None and (group, at) not in found:
            found.add((group, at))
            at = jumps.get((group, at))
    yield pd.DataFrame(sorted(found, key=str), columns=["group", "at"])
