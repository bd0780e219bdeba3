"""Which paths, rows and keys belong to a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspar.functions.labels import effective
from larkspar.functions.names import library_year, path_parts, path_prefixes


def in_scope(rows: DataFrame, key: str, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """rows whose path is included and not excluded; include, exclude: column ``path``.

    A path covers itself and what is below it.  No includes mean all; an exclude wins.  Ancestors are
    joined by equality, so that neither list is compared with every row.
    """
    exploded = rows.select(F.col(key).alias("_key"), F.explode(path_prefixes(F.col(key))).alias("path"))

    def covered(paths: DataFrame) -> DataFrame:
        return exploded.join(paths.select(F.trim(F.translate("path", "\\", "/")).alias("path")).select(F.regexp_replace("path", "/+$", "").alias("path")), "path", "left_semi").select("_key").distinct()

    if not include.isEmpty():
        rows = rows.join(covered(include), F.col(key) == F.col("_key"), "left_semi")
    return rows.join(covered(exclude), F.col(key) == F.col("_key"), "left_anti")


def funnel(rows: DataFrame, *stages: tuple[str, Column]) -> DataFrame:
    """How many rows pass each stage and all before it, in one pass over the rows."""
    passed, counts = F.lit(True), [F.count("*").alias("rows")]
    for name, condition in stages:
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return rows.agg(*counts)


# What becomes of a label row, in the order of the questions.
OUTCOMES = ("no_image_path", "filtered_out", "not_selected", "below_min_confidence", "missing_image", "resolved")
LABEL_COLUMNS = ("category", "label", "confidence", "applied", "prior_category", "prior_label")


def select_images(rows: DataFrame, images: DataFrame, include: DataFrame, exclude: DataFrame, categories: list[str] | None, min_confidence: float) -> DataFrame:
    """Label rows with what holds of them and their outcome: the first question of OUTCOMES that they fail, or resolved.

    rows: jpg (a path) and LABEL_COLUMNS; images: the paths (path) that are there; include, exclude: see in_scope; no categories mean all.
    Added columns: key, effective_category, species, sure (the confidence that holds), library, trip, stem, year, outcome.  Columns of these
    names are replaced.  A row without a known confidence is not dropped for it; repeated rows stay apart, each with its outcome.
    """
    held = effective(*[F.col(c) for c in LABEL_COLUMNS])
    key = F.trim(F.coalesce("jpg", F.lit("")))
    rows = rows.withColumn("_held", held).withColumns({"key": key, "effective_category": F.coalesce("_held.category", F.lit("")), "species": F.col("_held.species"), "sure": F.col("_held.confidence")}).drop("_held")
    parts = path_parts(F.col("key"))
    rows = rows.withColumns({c: parts[c] for c in ("library", "trip", "stem")}).withColumn("year", library_year(F.col("library")))
    wanted = in_scope(rows.select("key").filter("key <> ''").distinct(), "key", include, exclude).select("key", F.lit(True).alias("_wanted"))
    there = images.select(F.col("path").alias("key"), F.lit(True).alias("_there")).distinct()
    chosen = F.lit(True) if categories is None else F.col("effective_category").isin(*categories)
    questions = [F.col("key") == "", F.col("_wanted").isNull(), ~chosen, F.coalesce(F.col("sure") < min_confidence, F.lit(False)), F.col("_there").isNull()]
    outcome = F.coalesce(*[F.when(q, name) for q, name in zip(questions, OUTCOMES, strict=False)], F.lit(OUTCOMES[-1]))
    return rows.join(wanted, "key", "left").join(there, "key", "left").withColumn("outcome", outcome).drop("_wanted", "_there")


def selection_counts(selected: DataFrame) -> DataFrame:
    """The report of select_images (counter, value, n): rows, each outcome, in_scope and selected, selected rows by category, resolved
    ones by year, and how many species these have.

    Rows are counted once by outcome, category, year and species; all counters are sums over that small table's rows.
    """
    place = {name: i for i, name in enumerate(OUTCOMES)}
    counts = selected.groupBy("outcome", "effective_category", "year", "species").agg(F.count("*").alias("n"))
    past = lambda name: F.col("outcome").isin(*[o for o in OUTCOMES if place[o] > place[name]])
    entry = lambda counter, value, when: F.when(when, F.struct(F.lit(counter).alias("counter"), value.alias("value")))
    none, resolved = F.lit(None).cast("string"), F.col("outcome") == "resolved"
    entries = [
        entry("rows", none, F.lit(True)), *[entry(o, none, F.col("outcome") == o) for o in OUTCOMES if o != "not_selected"],
        entry("in_scope", none, past("filtered_out")), entry("selected", none, past("not_selected")),
        entry("category", F.coalesce(F.nullif("effective_category", F.lit("")), F.lit("none")), past("not_selected")), entry("year", F.col("year"), resolved),
    ]
    summed = counts.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"), "n").groupBy("e.counter", "e.value").agg(F.sum("n").alias("n"))
    species = counts.filter(resolved).agg(F.count_distinct("species").alias("n")).select(F.lit("species").alias("counter"), none.alias("value"), "n")
    return summed.unionByName(species)


def needs_relabel(category: Column, confidence: Column, note: Column, threshold: float) -> Column:
    """Animals, and whatever a model was not sure of; the category may only stand in the note, before a bracket."""
    from_note = F.when(note.contains("("), F.trim(F.split_part(note, F.lit("("), F.lit(1))))
    found = F.coalesce(F.nullif(category, F.lit("")), from_note)
    return F.coalesce(found == "animal", F.lit(False)) | (F.coalesce(confidence.try_cast("double"), F.lit(1.0)) < threshold)


def focused(rows: DataFrame, cluster: str, name: str, wanted: str) -> DataFrame:
    """Rows of the cluster with this id, or else of the one whose name holds the text; several are an error, as is none."""
    text = F.col(cluster).cast("string")
    named = rows.select(text.alias("id"), F.col(name).alias("name")).filter((F.col("id") == wanted) | F.coalesce(F.contains("name", F.lit(wanted)), F.lit(False)))
    found = sorted({r[0] for r in named.select("id").distinct().orderBy(F.col("id") != wanted, "id").limit(3).collect()}, key=lambda c: (c != wanted, c))
    if not found:
        raise ValueError(f"no cluster {wanted!r}")
    if found[0] != wanted and len(found) > 1:
        raise ValueError(f"{wanted!r} is in the names of several clusters: {', '.join(found)}")
    return rows.filter(text == found[0])


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that no earlier run has finished."""
    return items.join(done.select(key), key, "left_anti")


def require_one_fingerprint(rows: DataFrame, fingerprint: str) -> None:
    """Vectors of different models or sizes must not be mixed."""
    found = [r[0] for r in rows.select(fingerprint).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"vectors of more than one model: {sorted(map(str, found))}")


def fingerprint(model: Column, image_size: Column) -> Column:
    """What must agree for two vectors to lie in one file: the model, and the size that it was fed, if that is known."""
    size = F.nullif(F.nullif(image_size.cast("string"), F.lit("")), F.lit("0"))
    return F.concat(F.coalesce(model, F.lit("(unrecorded)")), F.lit("@"), F.coalesce(size, F.lit("(unrecorded)")))
