"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings inside of the block; afterwards they are what they were."""
    before = {k: spark.conf.getAll.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: The folder that new ones are made in, inside of ``passing``.
WITHIN: ContextVar[str | None] = ContextVar("within", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a local one on a single machine, else an error."""
    if within := WITHIN.get():
        return f"{within}/{uuid.uuid4().hex}"
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="larkspar-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/larkspar/{uuid.uuid4().hex}"


#: The table that is written is all that is left of its plan: its shuffles need no room any longer.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    with settings(spark, FREED):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator that are deleted together when the block ends; what outlasts it is stored() outside."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, shared_dir(spark), 0

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        return stored(df, f"{self.count}-{name}", self.folder)

    def drop(self, table: DataFrame) -> None:
        """Deletes one of its tables that is superseded."""
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            delete(self.spark, folder)

    def __exit__(self, *_) -> None:
        delete(self.spark, self.folder)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is stored inside of the block, by whatever operator, is deleted when it ends; only a folder from before outlasts it."""
    folder = shared_dir(spark)
    token = WITHIN.set(folder)
    try:
        yield
    finally:
        WITHIN.reset(token)
        delete(spark, folder)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
