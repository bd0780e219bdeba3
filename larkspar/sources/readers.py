"""Catalogue files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspar.functions.names import normalise_datetime, sidecar_stem
from larkspar.sources.schemas import EMBEDDINGS, LABELS

CAPTURE_FIELDS = ("DateTimeOriginal", "CreateDate", "OriginalDocumentID", "DocumentID", "RawFileName")


def tree(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files below a root: path, folder (from the root), stem, size. The content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    folder, stem = below(spark, root)
    return files.select("path", folder.alias("folder"), stem.alias("stem"), F.col("length").alias("size"))


def below(spark: SparkSession, root: str) -> tuple[Column, Column]:
    """(folder, stem) of the column path, below the root as its file system resolves it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    start = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(path).toString().rstrip("/")
    inside = F.substring(F.col("path"), len(start) + 2, 1 << 30)
    name = F.element_at(F.split(inside, "/"), -1)
    return F.regexp_replace(inside, r"/?[^/]*$", ""), F.regexp_replace(name, r"\.[^.]*$", "")


def label_table(spark: SparkSession, path: str) -> DataFrame:
    """A label run's CSV: a byte order mark is dropped, quotes may hold line breaks, a missing jpg column is fatal."""
    header = spark.read.option("header", True).csv(path).columns
    if "jpg" not in header:
        raise ValueError(f"{path} has no column jpg")
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path)
    missing = [f.name for f in LABELS if f.name not in header]
    return rows.withColumns({c: F.lit(None).cast("string") for c in missing}).select(*LABELS.names)


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Vectors as JSON lines; blank and broken lines are left out, and of a repeated key one row stays."""
    rows = spark.read.schema(EMBEDDINGS).option("mode", "PERMISSIVE").json(path).filter("key IS NOT NULL")
    newest = W.partitionBy("key").orderBy(F.desc("_line"))
    return rows.withColumn("_line", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_line", "_n")


def vectors_for(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The vectors of keys (position, key), one row for each: position, key, embedding. A key that the file lacks is an error.

    A frame has no order of its own: position is what the rows are ordered by.
    """
    found = keys.join(embeddings(spark, path).select("key", "embedding"), "key", "left").select("position", "key", "embedding")
    lost = found.filter("embedding IS NULL").agg(F.count_distinct("key"), F.min("key")).first()
    if lost[0]:
        raise ValueError(f"{lost[0]} keys are not in {path}, e.g. {lost[1]}")
    return found


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a scope list: # begins a comment, either slash separates; an empty list is an error."""
    line = F.trim(F.regexp_replace("value", r"#.*$", ""))
    paths = spark.read.text(path).select(F.regexp_replace(F.translate(line, "\\", "/"), r"^/+|/+$", "").alias("path")).filter("path <> ''")
    if paths.isEmpty():
        raise ValueError(f"{path} lists no path")
    return paths


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Sidecars of a tree: folder, stem, text (null where a file is no text)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xmp").load(root)
    folder, stem = below(spark, root)
    return files.select(folder.alias("folder"), stem.alias("stem"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


#: An element's beginning or end, with its attributes.
TAG = r"""<(/?[\w.:-]+)(?:\s+[\w.:-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*+\s*(/?)>"""


def well_formed(text: Column) -> Column:
    """Whether a text is one element with its tags in balance, so that XPath expressions can read it.

    Comments, declarations and CDATA go first; tags are then followed in order, with a list of those that are open.  It is
    an expression, so that a broken file costs its row only.
    """
    bare = F.regexp_replace(text, r"(?s)^\x{feff}|<\?.*?\?>|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<!DOCTYPE[^>]*>", "")
    sound = ~bare.rlike(r"&(?!(?:lt|gt|amp|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)")
    tags = F.regexp_extract_all(bare, F.lit(TAG), 0)
    names = F.transform(tags, lambda t: F.concat(F.regexp_extract(t, r"^<(/?[\w.:-]+)", 1), F.when(t.endswith("/>"), "!").otherwise("")))
    nothing = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("roots"), F.lit(True).alias("good"))
    top = lambda s: F.get(s["open"], F.size(s["open"]) - 1)

    def step(s: Column, t: Column) -> Column:
        first = (F.size(s["open"]) == 0).cast("int")
        closes = F.coalesce(F.concat(F.lit("/"), top(s)) == t, F.lit(False))
        opened = F.struct(F.concat(s["open"], F.array(t)).alias("open"), (s["roots"] + first).alias("roots"), s["good"].alias("good"))
        closed = F.struct(F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0))).alias("open"), s["roots"].alias("roots"), (s["good"] & closes).alias("good"))
        alone = F.struct(s["open"].alias("open"), (s["roots"] + first).alias("roots"), s["good"].alias("good"))
        return F.when(t.endswith("!"), alone).when(t.startswith("/"), closed).otherwise(opened)

    end = F.aggregate(names, nothing, step)
    rest = F.regexp_replace(bare, TAG, "")
    return F.coalesce(sound & ~rest.contains("<") & (F.size(end["open"]) == 0) & (end["roots"] == 1) & end["good"], F.lit(False))


def subjects(text: Column) -> Column:
    """The keywords of a sidecar's text, of all its subject blocks in order; null where it is no whole document.

    A broken sidecar is told from one that was never labelled: the one is null, the other has no keyword.
    """
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    blocks = F.regexp_extract_all(bare, F.lit(r"(?s)<(\w+:)subject(?:\s[^>]*)?>(.*?)</\1subject>"), F.lit(2))
    items = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?s)<(\w+:)li(?:\s[^>]*)?(?:/>|>([^<]*)(?:<(?!/\1li>).*?)?</\1li>)"), F.lit(2))))
    entity = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}

    def plain(x: Column) -> Column:
        for name, sign in entity.items():
            x = F.replace(x, F.lit(name), F.lit(sign))
        return x

    return F.when(well_formed(text), F.transform(items, plain))


def capture_fields(text: Column) -> Column:
    """(captured, original_id, document_id, raw_name) of a sidecar's text, from attributes or elements."""

    def field(name: str) -> Column:
        as_attribute = F.regexp_extract(text, rf'[\w]+:{name}="([^"]*)"', 1)
        as_element = F.regexp_extract(text, rf"(?s)<(?:\w+:){name}>(.*?)</", 1)
        return F.coalesce(F.nullif(as_attribute, F.lit("")), F.nullif(F.trim(as_element), F.lit("")))

    original, created, odid, did, raw = map(field, CAPTURE_FIELDS)
    return F.struct(normalise_datetime(F.coalesce(original, created)).alias("captured"), odid.alias("original_id"), did.alias("document_id"), raw.alias("raw_name"))


def report_entries(lines: DataFrame, *keys: str) -> DataFrame:
    """Entries of an indented report: lines (keys, pos, text) to keys, pos, reason, name, stem.

    A line that is not indented is a reason, without the (N) at its end; what is indented below it are
    its entries.  Of a repeated stem of one report the first entry stays.
    """
    header = ~F.col("text").rlike(r"^\s") & (F.trim("text") != "")
    reason = F.when(header, F.trim(F.regexp_replace("text", r"\s*\(\d+\)\s*$", "")))
    so_far = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    found = lines.withColumn("reason", F.last(reason, ignorenulls=True).over(so_far)).filter(F.col("text").rlike(r"^\s+\S") & F.col("reason").isNotNull())
    name = F.element_at(F.split(F.translate(F.trim("text"), "\\", "/"), "/"), -1)
    entries = found.select(*keys, "pos", "reason", name.alias("name")).withColumn("stem", sidecar_stem(F.regexp_replace("name", r"\.[^.]*$", "")))
    return entries.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "stem").orderBy("pos"))).filter("_n = 1").drop("_n")


def flat_names(names: DataFrame, libraries: DataFrame) -> DataFrame:
    """Exported names trip~~file to library, trip and file.

    The library is the known one of the trip (trip, library: the last by name), else its year's, else none.
    """
    parts = F.split("name", "~~", 2)
    known = libraries.groupBy("trip").agg(F.max("library").alias("known"))
    year = F.regexp_extract("trip", r"^20(\d\d)-", 1)
    rows = names.filter(F.col("name").contains("~~")).select("name", parts[0].alias("trip"), parts[1].alias("file")).join(known, "trip", "left")
    return rows.select("name", F.coalesce("known", F.when(year != "", F.concat(F.lit("Photos-"), year))).alias("library"), "trip", "file")
