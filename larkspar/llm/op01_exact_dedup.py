"""Exact deduplication as a stateful stream.

A stream of (digest, stable id, content locator) keeps one state row per digest in RocksDB, on the
executors' disks and in the checkpoint, without expiry: the id and locator of the row that stays and
the size of the group.  Partial aggregation before the shuffle makes one row of a hot text per task.
On a hit (a digest that more than one row has) the content that the state's locator names is fetched, and
its full bytes are compared with each different text of the hits; digests whose texts differ, should there be
any, are told apart by the texts themselves.

With a state folder of the caller's, contents, log and checkpoint stay there: a later call goes on where the
last one stopped, and its rows meet those of all calls before.

Null texts count as empty, and equal each other.  Of equal texts the row with the largest doc_id
stays; a null doc_id is smaller than any other, and of repeated rows one stays.  An empty table has an
empty result.  Other columns, whatever their names, are ignored by ``deduplicate`` and carried through by ``kept_rows``.
A text of any length is one row, compared whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspar.llm.common import fresh, settings, shared_dir, stored, table, with_few
from larkspar.storage import delete, exists

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: space set aside in advance would outweigh what they hold.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keep_in_state(arrivals: DataFrame, folder: str) -> DataFrame:
    """Runs the stream ``arrivals`` (digest, id, locator) until its present input is used up.

    The checkpoint in ``folder`` holds the state: a later call with more input goes on from there.
    Returns one row per digest: digest, keep (struct of id and locator), group_size.
    """
    spark = arrivals.sparkSession
    state = arrivals.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count("*").alias("group_size"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    spark.createDataFrame([], state.schema).write.mode("overwrite").parquet(f"{folder}/state/batch=-1")
    with settings(spark, STATE_STORE):
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(changed).start()
        query.awaitTermination()
    rows = spark.read.schema(T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/state")
    newest = F.max(F.struct("batch", "keep", "group_size")).alias("newest")
    return rows.groupBy("digest").agg(newest).select("digest", "newest.keep", "newest.group_size")


def grouped(docs: DataFrame, digest: Callable[[Column], Column], files_per_batch: int, folder: str | None) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as they are kept, with their number ``key``, and of each: key, id, digest, keep, group_size."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/dedup"
    key, call, mark = (fresh(docs, name) for name in ("_row", "_call", "_digest"))
    text = F.coalesce("text", F.lit(""))
    number = spark.read.parquet(f"{folder}/content").agg(F.max(call)).first()[0] + 1 if exists(spark, f"{folder}/content") else 0
    made = docs.withColumn(key, F.monotonically_increasing_id()).withColumn(mark, digest(text))
    made.write.option("compression", "zstd").parquet(f"{folder}/content/{call}={number}")
    content = spark.read.schema(T.StructType([*made.schema.fields, T.StructField(call, T.IntegerType())])).parquet(f"{folder}/content")
    plain = content.select(F.col(mark).alias("digest"), F.col("doc_id").alias("id"), F.struct(F.col(call).alias("call"), F.col(key).alias("row")).alias("locator"), text.alias("text"))
    own = plain.filter(F.col("locator.call") == number)
    log = own.select("digest", "id", "locator")
    log.write.mode("append").parquet(f"{folder}/log")
    arrivals = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/log")
    state = stored(keep_in_state(arrivals, folder), "state")

    # Each different text of the hits of this call against the content that the state's locator names.
    named = stored(state.filter("group_size > 1").select("keep.locator", "digest"), "named")
    hits = with_few(own, named.select("digest"), "digest").groupBy("digest", "text").agg(F.count("*").alias("n"))
    fetched = with_few(plain.select("locator", F.col("text").alias("kept_text")), named, "locator").select("digest", "kept_text")
    clashing = stored(hits.join(fetched, "digest").filter(F.col("text") != F.col("kept_text")).select("digest").distinct(), "clashing")
    if clashing.isEmpty():
        found = log.join(state, "digest")
    else:
        told = plain.join(clashing, "digest").groupBy("digest", "text").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count("*").alias("group_size"))
        apart = own.join(clashing, "digest").join(told, ["digest", "text"]).select("digest", "id", "locator", "keep", "group_size")
        found = log.join(state, "digest").join(clashing, "digest", "left_anti").unionByName(apart)
    return content.filter(F.col(call) == number), found.withColumn("key", F.col("locator.row"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 10_000, folder: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest.

    ``folder``, in storage that all executors share, holds the state between calls; docs are the rows that
    are new, and what they are compared with are all rows of that folder so far.
    """
    _, found = grouped(docs.select("doc_id", "text"), digest, files_per_batch, folder)
    return found.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", (F.col("locator") == F.col("keep.locator")).alias("kept"), "digest")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    key, folder = fresh(docs, "_row"), f"{shared_dir(docs.sparkSession)}/dedup"
    rows, found = grouped(docs, sha256, 10_000, folder)
    gone = stored(found.filter(F.col("locator") != F.col("keep.locator")).select(F.col("key").alias(key)), "gone")
    for part in ("log", "state", "checkpoint"):  # no later call goes on from here: of the folder only the contents are read again
        delete(docs.sparkSession, f"{folder}/{part}")
    return with_few(rows, gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
)
"""
