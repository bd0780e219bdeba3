"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Adds rows to a Parquet table; columns that differ from those there are an error."""
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path).columns
    except Exception as e:  # a table that is not there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = None
    if there is not None and sorted(there) != sorted(rows.columns):
        raise ValueError(f"{path} has the columns {there}, not {rows.columns}")
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header in each part; an existing result is replaced when the new one is complete."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def spreadsheet(rows: DataFrame, path: str, *columns: str) -> None:
    """The named columns as CSV that spreadsheet programs take for UTF-8: each part begins with a byte order mark and a header."""
    first, *rest = columns
    csv(rows.select(F.col(first).alias(f"\ufeff{first}"), *rest), path)
