"""Reports over catalogues: rollups, tails, and text that may identify somebody."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# What identifies a person or place in a line of text, and how a report's own lines begin.
IDENTIFYING = {
    "trip folder name": r"\b(?:19|20)\d{2}-\d{2}-\d{2}(?:[~-]\d{2})?\s+[A-Z\x{4e00}-\x{9fff}]\S*",
    "image key or path": r"(?i)\bPhotos-\d{2}\b|\b\w[\w-]*\.(?:jpg|jpeg|xmp|nef|arw|cr3|dng)\b",
    "GPS": r"\b\d{1,3},\d{1,2}\.\d+[NSEW]\b|\bGPS(?:Latitude|Longitude)\b|\b-?\d{1,3}\.\d{4,}\s*,\s*-?\d{1,3}\.\d{4,}\b",
    "camera serial": r"(?i)\b(?:BodySerialNumber|SerialNumber|serial)\b\W{0,3}([\w-]{4,})",
    "home directory path": r"/home/[^/\s`\"']+|/Users/[^/\s`\"']+",
    "CJK text": r"[\x{4e00}-\x{9fff}]+",
}
OWN_LINES = ("Generated by ", "No timestamp:")
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def rollup(rows: DataFrame, group: str, *aggregates: Column) -> DataFrame:
    """Aggregates per value of ``group`` and, where it is (all), over all rows."""
    found = rows.rollup(group).agg(F.grouping(group).alias("_all"), *aggregates)
    return found.withColumn(group, F.when(F.col("_all") == 1, "(all)").otherwise(F.col(group))).drop("_all")


def tail(rows: DataFrame, name: str, at_least: tuple[int, ...]) -> DataFrame:
    """How many names there are, how many stand once, and how many stand at least so often."""
    counts = rows.groupBy(name).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("names"), F.count_if(F.col("n") == 1).alias("singletons"), *[F.count_if(F.col("n") >= k).alias(f"at_least_{k}") for k in at_least])


def most_common(rows: DataFrame, name: str, k: int) -> DataFrame:
    """The k names that stand most often, ties by name."""
    return rows.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def vocabulary(rows: DataFrame) -> DataFrame:
    """The different names (name) in label and prior_label of bird rows that are specific.

    rows: category, prior_category, label, prior_label (a list joined by ;).  A row is a bird's if either category says so;
    a name has more than one word and 4 to 59 characters.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    birds = rows.filter((plain(F.col("category")) == "bird") | (plain(F.col("prior_category")) == "bird"))
    part = F.explode(F.concat(F.split(plain(F.col("label")), ";"), F.split(plain(F.col("prior_label")), ";")))
    shape = r"^[^-]+-[^-]+-(.+?)\(\d+%\)$"
    parts = birds.select(part.alias("part")).select(F.trim("part").alias("part")).select(F.when(F.col("part").rlike(shape), F.regexp_extract("part", shape, 1)).otherwise(F.col("part")).alias("part"))
    names = parts.select(F.trim(F.regexp_replace("part", r"\(\d+%\)$", "")).alias("name"))
    return names.filter(F.col("name").contains(" ") & F.length("name").between(4, 59)).distinct()


#: Bytes of names that one automaton holds, about: some 100 MB in a task.  A larger vocabulary takes several passes over the text.
VOCABULARY_BYTES = 1_500_000


def first_names(lines: DataFrame, keys: list[str], text: str, names: DataFrame) -> DataFrame:
    """lines (keys, text) that hold names (name) of a vocabulary, with the first of these in order: found.

    Each part of the vocabulary, of bounded size, becomes an automaton in the tasks, and every line is read once for it: the work is in
    proportion to the text, however long a line is and however many names begin alike.
    """
    size = names.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    parts = size // VOCABULARY_BYTES + 1
    schema = T.StructType([*(lines.schema[k] for k in keys), T.StructField("found", T.StringType())])

    def located(part: list[str]) -> DataFrame:
        held = lines.sparkSession.sparkContext.broadcast(part)  # VOCABULARY_BYTES, about

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for name in held.value:
                automaton.add_word(name, name)
            automaton.make_automaton()
            for batch in batches:
                found = pa.array([min((name for _, name in automaton.iter(t)), default=None) for t in batch.column(text).to_pylist()], pa.string())
                hit = found.is_valid()
                yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(hit) for k in keys), found.filter(hit)], schema=out)

        out = to_arrow_schema(schema)
        return lines.select(*keys, text).mapInArrow(run, schema)

    found = None
    for i in range(parts):
        part = [r[0] for r in names.filter((F.pmod(F.xxhash64("name"), F.lit(parts)) == i) & (F.col("name") != "")).select("name").distinct().collect()]
        if part:
            found = located(part) if found is None else found.unionByName(located(part))
    if found is None:
        return lines.select(*keys, F.lit(None).cast("string").alias("found")).filter("found IS NOT NULL")
    return found if parts == 1 else found.groupBy(*keys).agg(F.min("found").alias("found"))


def identifying(rows: DataFrame, text: str, *keys: str, user: str | None = None, names: DataFrame | None = None, per_key: int | None = None) -> DataFrame:
    """Findings (keys, line, kind, found): the first match of each kind in each line (from 1) of a text.

    ``user``: a person's name, found in any case; ``names`` (name): a vocabulary, of which the first name in order is found.
    ``per_key`` keeps so many findings of a kind per key; the cap is a reader's convenience.
    """
    lines = rows.select(*keys, F.posexplode(F.split(F.col(text), LINE_ENDS)).alias("line", "_text")).withColumn("line", F.col("line") + 1)
    for own in OWN_LINES:
        lines = lines.filter(~F.col("_text").startswith(own))
    kinds = [F.struct(F.lit(k).alias("kind"), F.trim(F.regexp_substr("_text", F.lit(f"(?U){p}"))).alias("found")) for k, p in IDENTIFYING.items()]
    if user:
        kinds.append(F.struct(F.lit("photographer's name").alias("kind"), F.when(F.lower("_text").contains(user.lower()), F.lit(user)).alias("found")))
    found = lines.select(*keys, "line", F.explode(F.filter(F.array(*kinds), lambda x: x["found"].isNotNull())).alias("x")).select(*keys, "line", "x.kind", "x.found")
    if names is not None:
        near = first_names(lines.withColumn("_low", F.lower("_text")), [*keys, "line"], "_low", names)
        found = found.unionByName(near.withColumn("kind", F.lit("species name")))
    if per_key is None:
        return found
    return found.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "kind").orderBy("line"))).filter(F.col("_n") <= per_key).drop("_n")


def movers(deltas: DataFrame, k: int) -> DataFrame:
    """deltas (label, delta): the k labels that gained most and the k that lost most, with their rank; no change is neither."""
    side = lambda kind, found, *order: found.orderBy(*order).limit(k).withColumn("kind", F.lit(kind))
    both = side("improved", deltas.filter("delta > 0"), F.desc("delta"), "label").unionByName(side("degraded", deltas.filter("delta < 0"), "delta", "label"))
    line = W.partitionBy("kind").orderBy(F.abs("delta").desc(), "label")  # k rows of each kind
    return both.withColumn("rank", F.row_number().over(line))
