"""Models behind a service: ordered concurrent calls from tasks, retries that back off, and a table of what failed for good."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Policy:
    """How a service is asked, and what becomes of a request that fails.

    ``size`` items make a request; ``concurrent`` requests of a task are under way at once, and answers keep their order.  A
    request is tried ``attempts`` times; after the k-th failure ``wait`` * 2 ** k seconds pass.  If all fail, its items are
    ``failed`` (the others go on), get the ``default`` answer, or ``stop`` the run.
    """

    size: int = 32
    concurrent: int = 4
    attempts: int = 3
    wait: float = 1.0
    on_failure: str = "failed"
    default: tuple | None = None

    def __post_init__(self) -> None:
        if self.on_failure not in ("failed", "default", "stop"):
            raise ValueError(f"unknown policy {self.on_failure!r}")
        if self.on_failure == "default" and self.default is None:
            raise ValueError("a default answer is missing")
        if min(self.size, self.concurrent, self.attempts) < 1:
            raise ValueError("sizes and attempts are 1 at least")


#: Requests whose answers leave a task together.
TOGETHER = 64


class Refused(Exception):
    """A service's answer that no further attempt can change."""


def tried(ask: Callable[[pd.DataFrame], list[tuple]], items: pd.DataFrame, policy: Policy) -> tuple[list[tuple | None], int, str | None]:
    """Answers to a request, the attempts that were made, and the last error if all failed."""
    for attempt in range(1, policy.attempts + 1):
        try:
            answers = list(ask(items))
            if len(answers) != len(items):
                raise ValueError(f"{len(answers)} answers to {len(items)} items")
            return answers, attempt, None
        except Exception as e:
            if policy.on_failure == "stop" and (attempt == policy.attempts or isinstance(e, Refused)):
                raise
            if attempt == policy.attempts or isinstance(e, Refused):
                given = policy.default if policy.on_failure == "default" else None
                return [given] * len(items), attempt, f"{type(e).__name__}: {e}"
            time.sleep(policy.wait * 2**attempt)
    raise AssertionError


def answered(items: DataFrame, key: str, connect: Callable[[], Callable[[pd.DataFrame], list[tuple]]], answer: str, policy: Policy = Policy()) -> DataFrame:
    """A row for each item: key, the fields of ``answer`` (DDL), attempts, and error (null for an answer).

    ``connect`` is called once in each task that has items, and gives the function that answers a frame of items, one tuple each, in their
    order.  What it raises there is the task's failure: a service that cannot be reached says nothing about items.
    """
    fields = T.StructType.fromDDL(answer).fields
    schema = T.StructType([items.schema[key], *fields, T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())])

    def requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            for first in range(0, len(batch), policy.size):
                request = batch[first : first + policy.size]
                request.index = pd.RangeIndex(len(request))
                yield request

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, waiting, done = None, deque(), []
        with ThreadPoolExecutor(policy.concurrent) as pool:
            for request in requests(batches):
                ask = ask or connect()
                waiting.append((request, pool.submit(tried, ask, request, policy)))
                if len(waiting) == policy.concurrent:
                    request, future = waiting.popleft()
                    done.append((request, *future.result()))
                if len(done) == TOGETHER:
                    yield framed(done)
                    done = []
            done += [(request, *future.result()) for request, future in waiting]
            if done:
                yield framed(done)

    def framed(done: list[tuple[pd.DataFrame, list[tuple | None], int, str | None]]) -> pd.DataFrame:
        """The answers to some requests in one frame: a frame of each would cost more than the answers."""
        keys = [k for request, *_ in done for k in request[key]]
        rows = [a if a is not None else (None,) * len(fields) for _, answers, *_ in done for a in answers]
        each = [(attempts, error) for _, answers, attempts, error in done for _ in answers]
        columns = {f.name: pd.Series([r[i] for r in rows], dtype=object) for i, f in enumerate(fields)}
        kept = pd.Series(keys, dtype=done[0][0][key].dtype)
        return pd.DataFrame({key: kept, **columns, "attempts": [a for a, _ in each], "error": pd.Series([e for _, e in each], dtype=object)})

    return items.mapInPandas(run, schema)


def numbered_results(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/results")


def results(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The newest result of each item that the runs in the folder have left."""
    key = schema.fields[0].name
    return numbered_results(spark, folder, schema).groupBy(key).agg(F.max_by(F.struct(*schema.names), F.struct(F.col("error").isNull(), "batch")).alias("x")).select("x.*")


def answer_stream(spark: SparkSession, source: str, folder: str, key: str, connect: Callable, answer: str, policy: Policy = Policy(), files_per_batch: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(answers, failures) of all items that a growing folder of Parquet files holds, each item asked for once.

    A call takes up where the last one stopped.  Results are written under their batch's number before the checkpoint moves on: a
    batch that is repeated after a crash replaces itself, so that no item is lost or stands twice.  Items with an
    answer, and repeated ones of a batch, are not asked for again; failures stay in their table until ``retry``.
    """
    schema = spark.read.parquet(source).schema
    out = answered(spark.createDataFrame([], schema), key, connect, answer, policy).schema
    spark.createDataFrame([], out).write.mode("overwrite").parquet(f"{folder}/results/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        known = numbered_results(batch.sparkSession, folder, out).filter(F.col("batch") != number).select(key)
        asked = batch.dropDuplicates([key]).join(known, key, "left_anti")
        answered(asked, key, connect, answer, policy).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")

    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = arrivals.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    found = results(spark, folder, out)
    return found.filter("error IS NULL").drop("error"), found.filter("error IS NOT NULL")


def retry(spark: SparkSession, source: str, folder: str, key: str, connect: Callable, answer: str, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(answers, failures) after the items that failed have been asked for once more."""
    items = spark.read.parquet(source)
    out = answered(items.limit(0), key, connect, answer, policy).schema
    failed = results(spark, folder, out).filter("error IS NOT NULL").select(key)
    least = numbered_results(spark, folder, out).agg(F.least(F.min("batch"), F.lit(-1))).first()[0]
    # Numbers below those of the stream's batches; an answer counts more than a failure, whatever their numbers.
    answered(items.dropDuplicates([key]).join(failed, key, "left_semi"), key, connect, answer, policy).write.mode("overwrite").parquet(f"{folder}/results/batch={least - 1}")
    found = results(spark, folder, out)
    return found.filter("error IS NULL").drop("error"), found.filter("error IS NOT NULL")
