"""Folders of runs: which are finished, which may be replaced, and which vectors a run was made from.

All paths are those of Spark's file systems.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from larkspar.storage import delete, exists

# The name of a run's folder, and the file that is written last, which makes a run a finished one.
RUN, FINISHED = re.compile(r"mcs\d+"), "run.json"


class Finished(Exception):
    """A finished run would be destroyed."""


def resolve_runs(spark: SparkSession, root: str, marker: str = "assignments") -> list[str]:
    """Folders below the root that hold the marker, by name; none is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise FileNotFoundError(f"{root} is not a folder")
    found = sorted(s.getPath().toString() for s in system.listStatus(path) if s.isDirectory() and exists(spark, f"{s.getPath().toString()}/{marker}"))
    if not found:
        raise FileNotFoundError(f"no {marker} below {root}")
    return found


def begin(spark: SparkSession, folder: str, force: bool = False) -> None:
    """Makes way for a run: a partial one is cleared, a finished one refused, unless ``force`` is set."""
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    if not exists(spark, folder):
        return
    if not RUN.fullmatch(name):
        raise ValueError(f"{folder} is not the folder of a run: it is not cleared")
    if exists(spark, f"{folder}/{FINISHED}") and not force:
        raise Finished(f"{folder} holds a finished run")
    delete(spark, folder)


def finish(spark: SparkSession, folder: str, assignments: DataFrame, summary: dict) -> None:
    """Writes a run: its rows first, and last the summary that makes it a finished one."""
    assignments.write.parquet(f"{folder}/assignments")
    write_text(spark, f"{folder}/{FINISHED}", json.dumps(summary, ensure_ascii=False, indent=2))


def write_text(spark: SparkSession, file: str, text: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def vectors_of(spark: SparkSession, run: str, explicit: str | None = None, live: str | None = None) -> str:
    """The vectors that a run was made from: those that are named, those that it recorded, those beside it below the same root, or the live ones."""
    if explicit is not None:
        return explicit
    recorded = None
    if exists(spark, f"{run}/{FINISHED}"):
        text = "\n".join(r[0] for r in spark.read.text(f"{run}/{FINISHED}", wholetext=True).collect())
        try:
            recorded = json.loads(text).get("source")
        except ValueError:  # a broken summary names none
            recorded = None
    root = run.rstrip("/").rsplit("/", 2)[0]
    for at in (recorded, f"{root}/embed/embeddings.jsonl", live):
        if at and exists(spark, at):
            return at
    raise FileNotFoundError(f"cannot tell which vectors {run} was made from")
