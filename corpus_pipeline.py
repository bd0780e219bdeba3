"""From raw documents to token counts of a training mixture, in five stages.

Each stage works on all that the one before kept; its result is written as Parquet and read again.  With it go the tables that
the stage worked with, and the result before.
Repeated rows after mixing are meant: a row stands as often as the mixture takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm import op01_exact_dedup, op06_jaccard, op07_sentencepiece, op09_mixing, op10_language
from larkspar.llm.common import shared_dir, stored, table
from larkspar.storage import delete, passing

#: Near duplicates: shingles of so many words, and the percentage of shared shingles.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told (null, empty, without letters), learning from docs.lang."""
    languages = op10_language.Languages.learn(op10_language.sample(docs, F.lit(True)))
    if not languages.names:  # no text has a known language
        return docs.filter(op10_language.has_letter(F.col("text")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = op10_language.identify(whole, languages, carry_text=False).filter(F.col("lang_pred") != op10_language.UNKNOWN)
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text."""
    return op01_exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates."""
    return op06_jaccard.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats the documents of small sources, up to twice, so that the largest source weighs less; loses none."""
    return op09_mixing.mixture(docs, max_repetition=op09_mixing.MAX_REPETITION)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row: the columns of docs but the text, with n_tokens, ids_sha256 and decoded_sha256."""
    return op07_sentencepiece.encode(docs, op07_sentencepiece.public_model())


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("sentencepiece", tokens)]

#: No SQL: language identification learns, and BPE merges cannot be put as a query. Held against brute force in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = shared_dir(spark)
        with passing(spark):
            docs = stored(stage(spark, docs, sf_dir), name, folder)
        if before:
            delete(spark, before)
        before = folder
    return docs
