"""Runs that take up where an earlier one stopped: Structured Streaming over files, with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def newest(spark: SparkSession, source: str, folder: str, key: str, version: str, files_per_batch: int = 1_000) -> DataFrame:
    """The newest row of each key of a growing folder of Parquet files.

    Each call takes the files that have come since the last; the state is one row per key.  What a batch
    changes is written under its number, so that a batch that is repeated after a failure replaces itself.
    """
    schema = spark.read.parquet(source).schema
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rest = [c for c in schema.names if c not in (key, version)]
    state = arrivals.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("row"), F.count("*").alias("versions"))
    out = state.select(key, "row.*", "versions")
    spark.createDataFrame([], out.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in out.columns if c != key]), "batch").alias("x"))
    return last.select(key, "x.*").select(*out.columns)
