"""Mixing sources to target weights by temperature.

The weight of a source is proportional to its share of all words to the power of an exponent between
0 (all sources alike) and 1 (as they are).  The exponent is bisected to meet a limit: the entropy of the
weights, or how often the smallest source may repeat.  Each source then gets its weight's part of the
budget of words: whole passes over its documents, and for the rest a prefix of a block permutation -
blocks of documents in hashed order, and documents in hashed order within a block.  Only the block
that the rest ends in is cut, and of a source only this block's documents meet in one task.  Where the
cut lies is one row per source; each document finds its copies from that, so texts are not shuffled.
All of it is DataFrame work, and nothing that grows with the sources comes to the driver.

A null source is a source of its own.  Documents without words belong to no budget and are taken once
per whole pass of their source, as are all documents of a source without words.  Repeated rows are taken
each by itself; ties of hashes go by row.  An empty table has an empty result.  Other columns, whatever their
names, are ignored by ``mix`` and carried through by ``mixture``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspar.llm.common import stored, table, with_row_key

#: Documents of a block, about, and blocks of a source at most.
BLOCK_ROWS, MOST_BLOCKS = 20_000, 4_096
ROUNDS = 40


def words(text):
    """How many words (runs of bytes that are not ASCII white space) a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def entropy_at(sizes: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy in bits of the weights for each exponent, in one pass over the sources' sizes."""
    total = []
    for i, a in enumerate(exponents):
        x = F.pow("share", F.lit(a))
        total += [F.sum(x).alias(f"x{i}"), F.sum(x * F.log2("share")).alias(f"l{i}")]
    got = sizes.agg(*total).first()
    return [math.log2(got[f"x{i}"]) - a * got[f"l{i}"] / got[f"x{i}"] for i, a in enumerate(exponents)]


def exponent(sizes: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None) -> float:
    """The largest exponent whose weights have the target entropy, or the smallest that keeps to the repetition limit.

    sizes: source, n_tokens, share of the sources with words.  Repetition is counted for the budget in
    which the largest source is passed once; it is smallest at exponent 1.
    """
    low, high = 0.0, 1.0
    if max_repetition is not None:
        least, most = sizes.agg(F.min("share"), F.max("share")).first()
        for _ in range(ROUNDS):
            middle = (low + high) / 2
            low, high = (low, middle) if (most / least) ** (1 - middle) <= max_repetition else (middle, high)
        return high
    for _ in range(ROUNDS // 4):  # each pass evaluates 15 points: four bisections at once
        points = [low + (high - low) * i / 16 for i in range(1, 16)]
        enough = [p for p, e in zip(points, entropy_at(sizes, points), strict=True) if e >= target_entropy]
        step = (high - low) / 16
        low, high = (max(enough), max(enough) + step) if enough else (low, low + step)
    return low


def cut_points(rows: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """sizes (source, passes, rest, blocks) with the place in the permutation up to which the rest is taken.

    The place is that of a block (cut_block, its hash first) and within this one of a row (cut_row); all places before it
    are taken.  Only the rows of each source's cut block are ordered one by one.
    """
    s = F.col("source").eqNullSafe(F.col("s"))
    of = sizes.select(F.col("source").alias("s"), "rest", "blocks")
    placed = rows.join(of, s).select("source", "n_tokens", "rest", block_place(seed, F.col("blocks")).alias("block"), row_place(seed).alias("row"))
    totals = placed.groupBy("source", "rest", "block").agg(F.sum("n_tokens").alias("tokens"))
    line = W.partitionBy("source").orderBy("block")  # MOST_BLOCKS rows at most
    totals = totals.withColumn("upto", F.sum("tokens").over(line)).filter(F.col("upto") > F.col("rest"))
    first = totals.groupBy(F.col("source").alias("s")).agg(F.min("block").alias("cut_block"), F.min(F.struct("block", (F.col("upto") - F.col("tokens")).alias("before")))["before"].alias("before"))
    inside = placed.join(first, s & (F.col("block") == F.col("cut_block")))
    upto = F.col("before") + F.sum("n_tokens").over(W.partitionBy("source").orderBy("row"))
    last = inside.withColumn("upto", upto).filter(F.col("upto") <= F.col("rest")).groupBy(F.col("source").alias("s2")).agg(F.max("row").alias("cut_row"))
    out = sizes.join(first.drop("before"), s, "left").drop("s")
    return out.join(last, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")


def block_place(seed: int, blocks: Column, number: Column | int = 0) -> Column:
    """Where a row's block stands in the permutation of blocks of a pass."""
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "_row", "doc_id"), blocks)
    return F.struct(F.xxhash64(F.lit(seed + 2), F.lit(number), block).alias("hash"), block.alias("block"))


def row_place(seed: int, number: Column | int = 0) -> Column:
    """Where a row stands within its block in a pass."""
    return F.struct(F.xxhash64(F.lit(seed), F.lit(number), "doc_id", "_row").alias("hash"), F.col("_row").alias("row"))


def planned(rows: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None, seed: int) -> DataFrame:
    """rows (_row, doc_id, source, n_tokens, and others) with weight, copies, and blocks (of the source)."""
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give either target_entropy or max_repetition")
    slim = rows.select("_row", "doc_id", "source", "n_tokens")
    sizes = slim.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_rows"))
    everything = slim.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    sizes = stored(sizes.withColumn("share", F.when(F.col("source_tokens") > 0, F.col("source_tokens") / F.lit(float(max(everything, 1))))), "sizes")
    filled = sizes.filter("share IS NOT NULL")
    if everything:
        a = exponent(filled, target_entropy, max_repetition)
        norm, most = filled.agg(F.sum(F.pow("share", F.lit(a))), F.max("share")).first()
    else:
        a, norm, most = 1.0, 1.0, 1.0
    if budget is None:
        budget = everything * most * norm / most**a
    weight = F.pow("share", F.lit(a)) / F.lit(norm)
    wanted = F.floor(weight * F.lit(float(budget)) + 0.5).cast("long")
    sizes = sizes.withColumn("weight", F.coalesce(weight, F.lit(0.0))).withColumn("wanted", F.coalesce(wanted, F.lit(0)))
    passes = F.when(F.col("source_tokens") > 0, F.floor(F.col("wanted") / F.col("source_tokens"))).otherwise(1).cast("long")
    sizes = sizes.withColumn("passes", passes).withColumn("rest", F.col("wanted") - F.col("passes") * F.col("source_tokens"))
    sizes = sizes.withColumn("blocks", F.least(F.ceil(F.col("source_rows") / BLOCK_ROWS), F.lit(MOST_BLOCKS)))
    cuts = stored(cut_points(slim, sizes, seed).select(F.col("source").alias("s"), "weight", "passes", "blocks", "cut_block", "cut_row"), "cuts")

    # The table of sources is as small as there are sources: Spark ships it whole where its size allows that.
    block, row = block_place(seed, F.col("blocks")), row_place(seed)
    taken = (block < F.col("cut_block")) | ((block == F.col("cut_block")) & F.coalesce(row <= F.col("cut_row"), F.lit(False)))
    extra = F.when(F.col("n_tokens") == 0, 0).otherwise(taken.cast("int"))
    out = rows.join(cuts, F.col("source").eqNullSafe(F.col("s")))
    return out.withColumn("copies", (F.col("passes") + extra).cast("int")).drop("s", "passes", "cut_block", "cut_row")


def mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None, seed: int = 0) -> DataFrame:
    """Per row of docs: _row, doc_id, source, n_tokens, weight (of its source), copies (how often it is taken).

    ``budget`` is the number of words of the mixture; by default such that the source with the largest
    share is passed once, so that no document is lost.
    """
    rows = with_row_key(docs.select("doc_id", "source", words(F.col("text")).alias("n_tokens")), "_row")
    return planned(rows, target_entropy, max_repetition, budget, seed).select("_row", "doc_id", "source", "n_tokens", "weight", "copies")


def mixture(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None, seed: int = 0, places: bool = False) -> DataFrame:
    """The documents of the mixture with all their columns: each row as often as it is taken.

    With ``places`` there is a column place, before the others, that stands for the mixture's order: the pass of the source
    (the partial one is 0), the block's place in this pass's permutation, and the row's within the block.  Sorted by it the
    rows are the budgeted block permutations.  A column of docs with that name is replaced.
    """
    rows = with_row_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", words(F.col("text")).alias("n_tokens")), "_row")
    taken = planned(rows, target_entropy, max_repetition, budget, seed).filter("copies > 0")
    taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns if not (places and c.lower() == "place")]
    place = F.struct(F.col("copy").alias("pass"), block_place(seed, F.col("blocks"), F.col("copy")).alias("block"), row_place(seed, F.col("copy")).alias("row"))
    return taken.select(*[place.alias("place")] * places, *columns)


#: No source is repeated more than this in the registered query.
MAX_REPETITION = 2.0


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, source, n_tokens, weight (rounded to 9 places), copies."""
    mixed = mix(table(spark, sf_dir, "documents"), max_repetition=MAX_REPETITION)
    return mixed.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "copies")
