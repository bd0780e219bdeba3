"""Trips on a timeline, and segments of them that reuse no file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.functions.names import trip_date
from larkspar.operators.order import numbered, orbit
from larkspar.storage import Scratch, stored


def ranked(trips: DataFrame) -> DataFrame:
    """trips (name) with their date and their rank on one timeline from 0; undated ones have rank -1."""
    dated = trips.withColumn("date", trip_date(F.col("name")))
    on_line = numbered(dated.filter("date IS NOT NULL"), "rank", "date", "name").withColumn("rank", (F.col("rank") - 1).cast("long"))
    return on_line.unionByName(dated.filter("date IS NULL").withColumn("rank", F.lit(-1).cast("long")))


def neighbours(ranks: DataFrame, window: int) -> DataFrame:
    """Pairs of dated trips at most ``window`` ranks apart, the earlier first, with the days between."""
    a = ranks.filter("rank >= 0").select("name", "date", "rank", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("apart"))
    b = ranks.filter("rank >= 0").select(F.col("name").alias("later"), F.col("date").alias("later_date"), F.col("rank").alias("later_rank"))
    joined = a.join(b, F.col("rank") + F.col("apart") == F.col("later_rank"))
    return joined.select("name", "later", "apart", F.date_diff("later_date", "date").alias("days"))


def collisions(frames: DataFrame, window: int) -> DataFrame:
    """frames (group, pos, key): keys in trips of one group that follow each other within ``window`` positions."""
    held = frames.select("group", "key", "pos").distinct()
    before = F.lag("pos").over(W.partitionBy("group", "key").orderBy("pos"))
    return held.withColumn("before", before).filter(F.col("pos") - F.col("before") <= window)


def digest(frames: DataFrame) -> DataFrame:
    """frames (group, trip, key, code, num): per trip its files, distinct keys, keys that repeat, and each code's counter range.

    ranges: code:low-high of every code, in order, joined by a comma.
    """
    keys = frames.groupBy("group", "trip", "code", "key").agg(F.count("*").alias("n"), F.min("num").alias("low"), F.max("num").alias("high"))
    codes = keys.groupBy("group", "trip", "code").agg(F.sum("n").alias("files"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.min("low").alias("low"), F.max("high").alias("high"))
    span = F.struct("code", F.concat_ws("", "code", F.lit(":"), F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string")).alias("text"))
    ranges = F.array_join(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["text"]), ",")
    return codes.groupBy("group", "trip").agg(F.sum("files").alias("files"), F.sum("keys").alias("keys"), F.sum("repeated").alias("repeated"), ranges.alias("ranges"))


def keys_of(frames: DataFrame) -> DataFrame:
    """The keys that trips hold, once each: group, pos, key."""
    return frames.select("group", "pos", "key").distinct()


def conflicts(frames: DataFrame) -> DataFrame:
    """frames (group, pos, key): per trip the last position before it that holds one of its keys, or null."""
    return conflicts_of(keys_of(frames))


def conflicts_of(held: DataFrame) -> DataFrame:
    """See conflicts; held: see keys_of."""
    before = F.lag("pos").over(W.partitionBy("group", "key").orderBy("pos"))
    return held.withColumn("before", before).groupBy("group", "pos").agg(F.max("before").alias("last"))


#: Children of a block in the levels over a line of positions.
FAN = 128


def last_reaching(line: DataFrame, limits: DataFrame) -> DataFrame:
    """limits (line, at, limit) with found: the last place before ``at`` on the line whose value is the limit or more, or null.

    line: line, at (from 0, without gaps on each line), value.  Blocks of FAN places know the places' values, blocks of FAN blocks
    their largest values, and so on: a limit is followed upwards until a block holds an earlier part that reaches it, and down again
    to the place.  Each step is a join on a block's number, so that no task sees a line.
    """
    parts = line.select("line", F.col("at").cast("long").alias("part"), "value")
    top = parts.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    with Scratch(line.sparkSession) as scratch:
        levels = []
        while True:
            held = F.array_sort(F.collect_list(F.struct("part", "value")))
            blocks = parts.groupBy("line", F.floor(F.col("part") / FAN).alias("block")).agg(held.alias("parts"), F.max("value").alias("value"))
            levels.append(scratch.stored(blocks, "blocks"))
            parts, top = levels[-1].select("line", F.col("block").alias("part"), "value"), top // FAN
            if top == 0:
                break

        def within(rows: DataFrame, level: int, wanted: Column, before: Column) -> DataFrame:
            """rows with seen: the last part below ``before`` of the wanted block that reaches the row's limit; no block: null."""
            blocks = levels[level].select(F.col("line").alias("_line"), F.col("block").alias("_block"), "parts")
            # Rows that ask for no block have keys of their own, so that they do not meet in one task.
            asked = rows.withColumn("_asked", F.coalesce(wanted, -1 - F.col("at")))
            joined = asked.join(blocks, (F.col("line") == F.col("_line")) & (F.col("_asked") == F.col("_block")), "left")
            seen = F.array_max(F.transform(F.filter("parts", lambda p: (p["part"] < before) & (p["value"] >= F.col("limit"))), lambda p: p["part"]))
            return joined.withColumn("seen", seen).drop("_line", "_block", "_asked", "parts")

        rows = limits.select("line", F.col("at").cast("long").alias("at"), "limit").withColumns({"found": F.lit(None).cast("long"), "level": F.lit(None).cast("int")})
        for level in range(len(levels)):
            own = F.floor(F.col("at") / FAN**level)
            rows = within(rows, level, F.when(F.col("found").isNull(), F.floor(own / FAN)), own)
            rows = rows.withColumn("level", F.when(F.col("found").isNull() & F.col("seen").isNotNull(), level).otherwise(F.col("level"))).withColumn("found", F.coalesce("found", "seen")).drop("seen")
        for level in range(len(levels) - 1, 0, -1):
            rows = within(rows, level - 1, F.when(F.col("level") >= level, F.col("found")), F.lit(2**62))
            rows = rows.withColumn("found", F.coalesce("seen", "found")).drop("seen")
        return stored(rows.select("line", "at", "limit", "found"), "found")


def range_conflicts(ranges: DataFrame) -> DataFrame:
    """ranges (group, pos, code, low, high; one row per code of a trip): per trip the last position before it from
    which on its code's envelope, the smallest low to the largest high of all trips in between, overlaps its own range.

    An envelope from q on reaches up to the trip if q is no later than the last trip with a high enough end, and down
    to it likewise; the earlier of the two is the conflict.
    """
    with Scratch(ranges.sparkSession) as scratch:
        ranges = scratch.stored(ranges.select(F.struct("group", "code").alias("line"), "pos", "low", "high"), "ranges")
        line = numbered(ranges, "at", "line", "pos")
        first = line.groupBy("line").agg(F.min("at").alias("_first"))
        placed = line.join(first, "line").select("line", (F.col("at") - F.col("_first")).alias("at"), F.col("pos").cast("long").alias("pos"), "low", "high")
        placed = scratch.stored(placed, "placed")
        # Both questions are one: of the ends, and of the begins with their sign turned.
        side = lambda sign, value, limit: placed.select(F.struct("line", F.lit(sign).alias("sign")).alias("line"), "at", value.alias("value"), limit.alias("limit"))
        both = side(1, F.col("high"), F.col("low")).unionByName(side(-1, -F.col("low"), -F.col("high")))
        reached = last_reaching(both.select("line", "at", "value"), both.select("line", "at", "limit"))
        either = reached.groupBy("line.line", "at").agg(F.count("found").alias("sides"), F.min("found").alias("found")).filter("sides = 2")
        met = either.join(placed.select("line", F.col("at").alias("found"), F.col("pos").alias("last")), ["line", "found"]).select("line", "at", "last")
        rows = placed.select("line", "at", "pos").join(met, ["line", "at"], "left")
        return stored(rows.groupBy(F.col("line.group").alias("group"), "pos").agg(F.max("last").alias("last")), "conflicts")


def segments(last: DataFrame) -> DataFrame:
    """Positions (group, pos, last: see conflicts) with segment, from 1: greedy, as few as possible.

    A segment that begins at s ends before the first position whose conflict is at s or later.  That jump is
    known for every s at once, and the begins are what is reached from the group's first position.
    """
    last = stored(last.select("group", "pos", "last"), "conflicts")  # a row for each trip: it is read four times
    starts = last.select("group", F.col("pos").alias("at"), F.col("pos").alias("value"), F.lit(None).cast("long").alias("end"))
    ends = last.filter("last IS NOT NULL").select("group", F.lit(None).cast("long").alias("at"), F.col("last").alias("value"), F.col("pos").alias("end"))
    line = W.partitionBy("group").orderBy(F.desc("value"), F.col("at").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    jumps = starts.unionByName(ends).withColumn("next", F.min("end").over(line)).filter("at IS NOT NULL").select("group", "at", "next")
    first = last.groupBy("group").agg(F.min("pos").alias("at"))
    begins = orbit(jumps, first).withColumn("begins", F.lit(1))
    running = F.sum(F.coalesce("begins", F.lit(0))).over(W.partitionBy("group").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return stored(last.join(begins.withColumnRenamed("at", "pos"), ["group", "pos"], "left").select("group", "pos", running.alias("segment")), "segments")


def cuts(frames: DataFrame, parts: DataFrame) -> DataFrame:
    """What opened each segment but the first of a group: group, segment, pos, the key that would have come again, and owner, the first trip
    (its pos) of the segment before that holds it.

    frames: group, pos, key; parts: see segments.
    """
    return cuts_of(keys_of(frames), parts)


def cuts_of(held: DataFrame, parts: DataFrame) -> DataFrame:
    """See cuts; held: see keys_of."""
    held = held.join(parts, ["group", "pos"])
    first = parts.groupBy("group", "segment").agg(F.min("pos").alias("pos"))
    owner = F.min("pos").over(W.partitionBy("group", "key").orderBy("segment").rangeBetween(-1, -1))  # of the segment before
    return held.withColumn("owner", owner).filter("owner IS NOT NULL").join(first, ["group", "segment", "pos"], "left_semi").select("group", "segment", "pos", "key", "owner")


def verify(frames: DataFrame, parts: DataFrame) -> DataFrame:
    """Per segment: trips, files, keys, and keys that more than one of its trips holds (must be none)."""
    held = frames.groupBy("group", "pos", "key").agg(F.count("*").alias("n")).join(parts, ["group", "pos"])
    keys = held.groupBy("group", "segment", "key").agg(F.count("*").alias("trips"), F.sum("n").alias("files"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return keys.groupBy("group", "segment").agg(F.min("first").alias("first_pos"), F.max("last").alias("last_pos"), F.sum("files").alias("files"), F.count("*").alias("keys"), F.count_if(F.col("trips") > 1).alias("crossing"))
