"""Events in their own time: sessions, windows and repeated events, of tables and of streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def timed(events: DataFrame, lateness: str) -> DataFrame:
    """events by their time: of a stream with a watermark, for which times without a zone are taken in the session's."""
    if not events.isStreaming:
        return events.filter("ts IS NOT NULL")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def once(events: DataFrame, key: str, lateness: str) -> DataFrame:
    """Each event once: of a stream, repetitions that come within ``lateness`` of the first; of a table, all."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return timed(events, lateness).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, user: str, gap: str, lateness: str) -> DataFrame:
    """Runs of a user's events no further apart than ``gap``: session_start, session_end (the last event and the gap), events, total.

    Of a stream a session appears when it is closed: no event that it could still take is accepted any longer.  State is
    kept for open sessions only.
    """
    found = timed(events, lateness).groupBy(F.col(user), F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return found.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "total")


def window_counts(events: DataFrame, kind: str, width: str, lateness: str) -> DataFrame:
    """Counts and sums per kind and tumbling window of a table, or of a stream's closed windows."""
    counted = timed(events, lateness).groupBy(F.window("ts", width).alias("w"), F.col(kind)).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "events", "total")


def closed_sessions(spark: SparkSession, source: str, folder: str, key: str, user: str, gap: str, lateness: str, files_per_batch: int = 1_000) -> DataFrame:
    """Closed sessions of a growing folder of Parquet files of events, each event counted once.

    A call takes up where the last one stopped: state and watermark are in the checkpoint.  A batch that is repeated after a
    crash replaces what it wrote.
    """
    schema = spark.read.parquet(source).schema
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    # One watermark serves both: what comes later than it is in neither.
    unique = once(arrivals, key, lateness)
    counted = unique.groupBy(F.col(user), F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    out = counted.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "total")
    spark.createDataFrame([], out.schema).write.mode("overwrite").parquet(f"{folder}/sessions/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/sessions/batch={number}")

    query = out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    found = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/sessions").drop("batch")
    return found.withColumns({c: F.col(c).cast(schema["ts"].dataType) for c in ("session_start", "session_end")})
