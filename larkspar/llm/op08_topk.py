"""Exact top-k search by distributed histogram selection.

All queries meet all candidates in blocks of bounded size, as integer matrix products.  Each round
counts, per query, the scores that fall into the bins of the interval that holds the kth highest score;
summed over the blocks, the histogram tells the bin of the kth score, which is the next round's interval.
A block only sends its highest bins, down to the one where its own count reaches k: lower ones cannot
hold the kth score.  When the interval is one value wide, the scores that reach it are taken, ties by
the smaller vec_id.  A vector that a third of all rows share costs no more than any other.

Vectors that are null or hold null, NaN or infinite components, and rows without vec_id, take no part.
Only vectors of one length meet.  Inner products must fit into a long.  Where vec_id repeats, each row
is a query and a candidate of its own.  An empty table has an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspar.llm.common import stored, table, with_row_key

QUERY_BLOCK, CANDIDATE_BLOCK = 4_096, 16_384
BINS = 4_096
#: Scores that are held at once while two blocks are multiplied.
SCORES_AT_ONCE = 4_000_000
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**53


def scaled(vector: Column) -> Column:
    """floor(1024 * x) of each component, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("double"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def products(queries: pd.DataFrame, candidates: pd.DataFrame):
    """Yields (rows of queries, their scores with all candidates as int64, whether a pair counts)."""
    ids = candidates["row"].to_numpy()
    if not len(queries) or not len(candidates):
        return
    c = np.stack(candidates["v"].to_numpy())
    exact = np.sqrt((c * c).sum(1)).max()
    step = max(1, SCORES_AT_ONCE // len(candidates))
    for first in range(0, len(queries), step):
        part = queries.iloc[first : first + step]
        q = np.stack(part["v"].to_numpy())
        if exact * np.sqrt((q * q).sum(1)).max() < EXACT:
            scores = (q @ c.T).astype(np.int64)
        else:
            scores = q.astype(np.int64) @ c.T.astype(np.int64)
        yield part, scores, part["row"].to_numpy()[:, None] != ids[None, :]


def histogram(k: int):
    def count(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, scores, counts in products(queries, candidates):
            low, high, step = (part[c].to_numpy()[:, None] for c in ("low", "high", "step"))
            bins = (scores - low) // step
            counts &= (scores >= low) & (scores < high)
            at = np.arange(len(part))[:, None] * BINS + bins
            table = np.bincount(at[counts], minlength=len(part) * BINS).reshape(len(part), BINS)[:, ::-1]
            before = np.cumsum(table, 1) - table
            row, col = np.nonzero((table > 0) & (before < k))
            out.append(pd.DataFrame({"row": part["row"].to_numpy()[row], "bin": BINS - 1 - col, "n": table[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "bin": [], "n": []}).astype("int64")

    return count


def reached(k: int):
    def take(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        candidates = candidates.sort_values(["vec_id", "row"], ignore_index=True)
        for part, scores, counts in products(queries, candidates):
            counts &= scores >= part["low"].to_numpy()[:, None]
            for i in np.flatnonzero(counts.any(1)):
                at = np.flatnonzero(counts[i])
                at = at[np.argsort(-scores[i, at], kind="stable")][:k]
                out.append(pd.DataFrame({"row": part["row"].iat[i], "query_id": part["vec_id"].iat[i], "vec_id": candidates["vec_id"].to_numpy()[at], "candidate": candidates["row"].to_numpy()[at], "score": scores[i, at]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("row", "query_id", "vec_id", "candidate", "score")}).astype("int64")

    return take


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """vectors: vec_id, embedding. Returns query_id, rank, vec_id, score."""
    rows = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = with_row_key(rows.select("vec_id", is_query.alias("q"), scaled(F.col("embedding")).alias("v")), "row")
    rows = rows.select("row", F.col("vec_id").cast("long"), "q", "v", F.size("v").alias("d"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
    rows = stored(rows, "vectors")
    n_queries, n_rows, longest = rows.agg(F.count_if("q"), F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    query_blocks, blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // CANDIDATE_BLOCK))
    spread = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("row", "vec_id", "v", "d", spread(blocks).alias("cb"), everywhere(query_blocks).alias("qb"))

    # The interval of each query: from low to below high, in BINS bins at most of the width step.
    bound = F.ceil(F.least(F.col("norm") * longest * (1 + 1e-9), F.lit(4e18))) + 1
    state = rows.filter("q").select("row", "vec_id", "v", "d", (-bound).cast("long").alias("low"), (bound + 1).cast("long").alias("high"), F.ceil((2 * bound + 1) / BINS).cast("long").alias("step"), F.lit(0).cast("long").alias("above"))
    while state.filter("step >= 1").limit(1).count():
        # A query whose kth score is known has step 0 and takes no part in further rounds.
        open_queries = state.filter("step >= 1").select("row", "vec_id", "v", "d", "low", "high", "step", spread(query_blocks).alias("qb"), everywhere(blocks).alias("cb"))
        counts = open_queries.groupBy("d", "qb", "cb").cogroup(candidates.groupBy("d", "qb", "cb")).applyInPandas(histogram(k), "row long, bin long, n long")
        high = W.partitionBy("row").orderBy(F.desc("bin"))
        summed = counts.groupBy("row", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(high)).join(state.select("row", "above"), "row")
        found = summed.filter(F.col("above") + F.col("upto") >= k).groupBy("row").agg(F.max(F.struct("bin", (F.col("above") + F.col("upto") - F.col("n")).alias("over"))).alias("x"))
        fewer = F.col("x").isNull()  # fewer than k scores in all: everything is taken
        state = state.join(found, "row", "left").select(
            "row", "vec_id", "v", "d",
            F.when(fewer | (F.col("step") == 0), F.col("low")).otherwise(F.col("low") + F.col("x.bin") * F.col("step")).alias("low"),
            F.when(fewer, F.col("high")).otherwise(F.col("low") + (F.col("x.bin") + 1) * F.col("step")).alias("high"),
            F.when(fewer | (F.col("step") <= 1), 0).otherwise(F.ceil(F.col("step") / BINS)).cast("long").alias("step"),
            F.when(fewer, F.col("above")).otherwise(F.col("x.over")).alias("above"),
        )
        state = stored(state, "interval")
    ready = state.select("row", "vec_id", "v", "d", "low", spread(query_blocks).alias("qb"), everywhere(blocks).alias("cb"))
    hits = ready.groupBy("d", "qb", "cb").cogroup(candidates.groupBy("d", "qb", "cb")).applyInPandas(reached(k), "row long, query_id long, vec_id long, candidate long, score long")
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id", "candidate")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of each vector whose vec_id is divisible by 100: query_id, rank, vec_id, score."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
