"""The registered queries over the given tables.

The tables hold no photographs, so each operator works on them by a fixed analogy: vectors are the
embeddings with their label as cluster, paths are the pages' addresses, trips are the days of orders, files
are line items, label rows are documents with their labels.  Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.functions import labels as L
from larkspar.functions import metadata
from larkspar.functions import names as N
from larkspar.functions.vectors import doubles, norm, normalised
from larkspar.operators import audit, captures, claims, clusters, hierarchy, layout, merge, neighbours, order, radial, scope, spectral, timeline
from larkspar.plans import marks
from larkspar.plans.oracle import ORACLE_SQL
from larkspar.sources import readers
from larkspar.storage import shared_dir, stored
from larkspar.streaming import connectors, event_time, incremental

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers f(t), where t(name) is a table, as a query under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    run.__doc__ = f.__doc__
    run.rows = f
    QUERIES[f.__name__] = run
    return run


def vectors(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("long").alias("cluster"), doubles(F.col("embedding")).alias("v"))


def in_order(t) -> DataFrame:
    """Vectors by cluster and key, with their position."""
    return order.numbered(vectors(t), "position", "cluster", "key")


def label_rows(t) -> DataFrame:
    """Documents as rows of a label run: some left in place, with a prior label."""
    d = t("documents").join(t("labels"), "doc_id", "left")
    prior = F.concat(F.lit("xx-yy-"), F.col("source"), F.lit(" bird("), (F.col("doc_id") % 101).cast("string"), F.lit("%)"))
    return d.select(
        "doc_id", "source", F.col("lang").alias("label"), F.when(F.coalesce("toxic", F.lit(0)) == 1, "animal").otherwise("Bird ").alias("category"),
        F.when(F.col("doc_id") % 11 == 0, "n/a").otherwise(((F.col("doc_id") % 100) / 100).cast("string")).alias("confidence"),
        F.when(F.col("quality") == 1, "kept-existing").otherwise("written").alias("applied"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("bird").alias("prior_category"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("no label")).otherwise(F.concat(F.lit("odd;"), prior)).alias("prior_label"),
    )


@query
def cluster_report(t):
    return clusters.report(vectors(t)).withColumnRenamed("cluster", "label")


@query
def cluster_size_marked(t):
    """Label 0 stands for noise; the sequence number is given before any sorting."""
    rows = order.numbered(t("embeddings").select("vec_id", F.col("label").alias("cluster_id")), "seq", "vec_id")
    return clusters.sized(rows, "cluster_id", 0).select("seq", "vec_id", "cluster_id", "cluster_size").orderBy(F.coalesce("cluster_size", F.lit(0)).desc(), "cluster_id", "seq")


@query
def label_agreement(t):
    return clusters.agreement(t("documents"), "source", "lang")


@query
def dominant_share(t):
    return clusters.dominant(t("documents"), "source", "lang")


@query
def run_summary(t):
    return clusters.summary(t("embeddings"), "label", 0)


@query
def homogeneity_completeness(t):
    return clusters.homogeneity(t("documents"), "source", "lang")


@query
def path_scope_filter(t):
    """Pages of two languages, without one host and one directory."""
    pages = t("pages").select("page_id", N.path_key(F.col("url")).alias("key"))
    hosts = pages.select(F.split("key", "/")[0].alias("host"), F.split("key", "/")[1].alias("lang"))
    include = hosts.filter(F.col("lang").isin("en", "fr")).select(F.concat_ws("/", "host", "lang").alias("path")).distinct()
    exclude = hosts.groupBy().agg(F.min("host").alias("path")).union(hosts.filter("lang = 'fr'").groupBy().agg(F.concat(F.max("host"), F.lit("/fr/")).alias("path"))).filter("path IS NOT NULL")
    return scope.in_scope(pages, "key", include, exclude)


@query
def path_parts(t):
    key = N.path_key(F.col("url"))
    library = F.concat(F.lit("Photos-"), F.lpad((F.col("page_id") % 30).cast("string"), 2, "0"))
    return t("pages").select("page_id", N.path_parts(key)["library"].alias("library"), N.path_parts(key)["trip"].alias("trip"), N.path_parts(key)["stem"].alias("stem"), N.library_year(library).alias("year"))


@query
def scope_funnel(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    return scope.funnel(d, ("in_scope", F.col("source") != "src0"), ("labelled", F.col("quality").isNotNull()), ("selected", F.col("lang").isin("en", "de")), ("confident", F.col("quality") == 1), ("long_enough", F.col("n_chars") >= 200))


@query
def effective_label(t):
    rows = label_rows(t)
    e = L.effective(*[F.col(c) for c in ("category", "label", "confidence", "applied", "prior_category", "prior_label")])
    return rows.select("doc_id", e["category"].alias("category"), e["species"].alias("species"), F.round(e["confidence"], 4).alias("confidence"))


def selection(t) -> DataFrame:
    """Documents as label rows of images: birds and animals of all libraries but one and a part of another, some paths blank, some images gone."""
    k = F.col("doc_id")
    path = F.concat(F.lit("Photos-"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit("/"), F.col("source"), F.lit("/"), k.cast("string"), F.lit(".jpg"))
    rows = label_rows(t).withColumn("jpg", F.when(k % 31 == 0, " ").otherwise(path))
    images = rows.filter(k % 17 != 0).select(F.col("jpg").alias("path"))
    libraries = t("documents").select(F.concat(F.lit("Photos-"), F.lpad((k % 30).cast("string"), 2, "0")).alias("path")).filter("path <> 'Photos-29'").distinct()
    part = t("documents").filter(k % 30 < 15).select(F.concat(F.lit("Photos-"), F.lpad((k % 15).cast("string"), 2, "0"), F.lit("/src1/")).alias("path")).distinct()
    return scope.select_images(rows, images, libraries, part, ["bird", "animal"], 0.25)


@query
def candidate_selection(t):
    return selection(t).select("doc_id", "outcome", "effective_category", "species", F.round("sure", 4).alias("sure"), "library", "trip", "stem", "year")


@query
def selection_report(t):
    return scope.selection_counts(selection(t))


@query
def relabel_filter(t):
    rows = label_rows(t).withColumn("category", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.trim("category")))
    note = F.when(F.col("doc_id") % 7 == 0, "animal (unsure)").when(F.col("doc_id") % 7 == 1, "animal").otherwise("bird (sure)")
    return rows.filter(scope.needs_relabel(F.col("category"), F.col("confidence"), note, 0.3)).select("doc_id")


NATIVE_NAMES = ("麻雀", "白鹭", "银喉长尾山雀", "小䴙䴘", "Great 鸻", "", "绣眼鸟", "儿", "坐")


def part_labels(t) -> DataFrame:
    """Parts as label strings, some without confidence or with a bare category."""
    full = F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("-"), F.col("p_type"), F.lit("-"), F.col("p_name"), F.lit("("), F.col("p_size").cast("string"), F.lit("%)"))
    text = F.when(F.col("p_partkey") % 13 == 0, F.col("p_name")).when(F.col("p_partkey") % 13 == 1, F.lit("bird")).otherwise(full)
    return t("part").withColumn("text", text)


@query
def parse_label_strings(t):
    x = L.parse_label(F.col("text"))
    return part_labels(t).select("p_partkey", x["initials"].alias("initials"), x["native"].alias("native"), x["english"].alias("english"), x["confidence"].alias("confidence"))


@query
def split_keywords(t):
    """Keywords of parts: a category of either generation or none, labels, phrases, and some written by hand."""
    hand = F.concat(F.lit("xs-小隼 "), F.col("p_name"))
    category = F.when(F.col("p_partkey") % 3 == 0, "bird").when(F.col("p_partkey") % 3 == 1, " Unknown").otherwise("my_birds")
    words = F.array(category, F.col("text"), F.col("p_name"), hand, F.lit("_nb"), F.col("p_type"), F.when(F.col("p_partkey") % 5 == 0, "People").otherwise("Family"))
    rows = part_labels(t).withColumn("words", words)
    ours, theirs = L.split_keywords(F.col("words"))
    paths = F.array(F.concat(F.lit("animals|"), F.col("text")), F.concat(F.lit("places|"), F.col("p_type")))
    new = F.array(F.concat(F.lit("birds|"), F.col("p_name")))
    return rows.select(
        "p_partkey", F.array_join(ours, ";").alias("ours"), F.array_join(theirs, ";").alias("theirs"),
        F.array_join(L.merge_keywords(theirs, F.lit("bird"), F.col("p_type")), ";").alias("merged"), F.array_join(L.merge_paths(paths, ours, new), ";").alias("paths"),
    )


@query
def prior_labels(t):
    """What earlier runs left among a part's keywords."""
    category = F.when(F.col("p_partkey") % 3 == 0, "bird").when(F.col("p_partkey") % 3 == 1, "Unknown").otherwise("my_birds")
    x = L.prior_labels(F.array(F.col("p_name"), category, F.col("text"), F.lit("_nb")))
    return part_labels(t).select("p_partkey", x["category"].alias("category"), x["label"].alias("label"))


@query
def effective_keyword(t):
    """The keyword that holds for a label row, with and without a native name."""
    rows = label_rows(t).withColumn("native", F.when(F.col("doc_id") % 4 == 0, " ").when(F.col("doc_id") % 4 == 1, "小隼"))
    made = L.effective_keyword(*[F.col(c) for c in ("label", "native")], F.lit("xs"), *[F.col(c) for c in ("confidence", "applied", "prior_category", "prior_label")])
    return rows.select("doc_id", made.alias("keyword"))


@query
def format_label(t):
    """Account balances in hundredths as confidences: quarters of a percent, so that halves are exact."""
    quarter = F.floor((F.col("s_acctbal") + 1000) / 30)
    c = F.col("quarter") / 400.0
    category = F.when(F.col("s_suppkey") % 3 == 0, "bird").when(F.col("s_suppkey") % 3 == 1, "animal").otherwise("scenery")
    native = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("cn")
    made = L.make_label(category, F.lower("s_name"), native, F.lit("c"), c)
    return t("supplier").withColumn("quarter", quarter).select("s_suppkey", made.alias("label"), L.share(F.col("s_suppkey"), F.col("s_nationkey")).alias("share"), L.tagged_digest(F.col("s_name")).alias("digest"))


@query
def pinyin_labels(t):
    """Initials of native names, with a share or a percentage as confidence; some names are Latin, empty or missing."""
    names = F.array(*[F.lit(x) for x in NATIVE_NAMES])
    k = F.col("p_partkey")
    native = F.when(k % 23 == 0, F.lit(None)).when(k % 23 == 1, F.concat(F.col("p_brand"), F.lit("麻雀"))).otherwise(F.get(names, (k % len(NATIVE_NAMES)).cast("int")))
    sure = F.when(k % 2 == 0, (k % 801) / 800.0).otherwise((k % 397) / 4.0 + 1.125)
    return t("part").select("p_partkey", L.initials_label(native, sure).alias("label"))


#: Parts of which a task makes and cleans sidecars: some seconds.
SIDECARS_PER_TASK = 10_000


def part_sidecars(t) -> DataFrame:
    """Sidecars of parts, some without a serial number or a rating, with settings, a history and a keyword.

    A file of parts is small, but their sidecars are much work: parts are dealt to tasks before their sidecars are made.
    """
    parts = t("part").select("p_partkey", "p_brand", "p_size", "p_name")
    parts = parts.repartition(parts.count() // SIDECARS_PER_TASK + 1, "p_partkey")
    k = F.col("p_partkey").cast("string")
    serial = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('\n   aux:SerialNumber="'), k, F.lit('"'))).otherwise("")
    rating = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('\n   xmp:Rating="'), F.col("p_size").cast("string"), F.lit('"'))).otherwise("")
    text = F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/">\n <rdf:Description rdf:about=""'), serial, F.lit('\n   tiff:Make="'), F.col("p_brand"), F.lit('"\n   crs:Exposure2012="+0.10"'), rating,
        F.lit('\n   xmpMM:DocumentID="d'), k, F.lit('">\n  <crs:ToneCurve>\n   <rdf:li>0, 0</rdf:li>\n  </crs:ToneCurve>\n  <dc:subject>'), F.col("p_name"), F.lit("</dc:subject>\n </rdf:Description>\n</x:xmpmeta>"),
    )
    return parts.select("p_partkey", text.alias("text"))


@query
def sidecar_scrub(t):
    """Sidecars without what identifies, and with what readers need alone."""
    x = metadata.scrubbed(F.col("text"))
    return part_sidecars(t).select("p_partkey", x["text"].alias("scrubbed"), F.array_join(x["removed"], ",").alias("removed"), metadata.minimal(F.col("text")).alias("minimal"))


@query
def frame_identity(t):
    k = F.col("p_partkey")
    stem = F.concat(F.when(k % 3 == 0, "20190501-").otherwise(""), F.when(k % 4 == 0, "_").otherwise(""), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("D"), (k % 9).cast("string"), F.lit("S"))), F.lpad(k.cast("string"), 5 - (k % 11 == 0).cast("int") * 2, "0"), F.when(k % 7 == 0, "-2").when(k % 7 == 1, "-Enhanced-NR").when(k % 7 == 2, "-Pano-3").when(k % 7 == 3, "_host_1_Conflict").otherwise(""))
    x = N.frame_identity(F.col("stem"))
    return t("part").select("p_partkey", stem.alias("stem")).select("p_partkey", "stem", x["code"].alias("code"), x["num"].alias("num"), N.sidecar_stem(F.col("stem")).alias("sidecar"), N.is_virtual_copy(F.col("stem")).alias("is_copy"))


def trip_rows(t) -> DataFrame:
    """Orders as captures in trips named by month, day, or with an impossible date; some dated days after the trip."""
    o = t("orders")
    k = F.col("o_orderkey")
    shown = F.date_sub(F.col("o_orderdate").cast("date"), (k % 5).cast("int"))
    name = F.when(k % 17 == 0, F.concat(F.date_format(shown, "yyyy"), F.lit("-13-40 odd"))).when(k % 3 == 0, F.date_format(shown, "yyyy-MM")).otherwise(F.concat(F.date_format(shown, "yyyy-MM-dd"), F.lit(" "), F.col("o_orderstatus")))
    return o.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("captured"), name.alias("trip"))


@query
def trip_dates(t):
    c, n = F.col("captured"), F.col("trip")
    return trip_rows(t).select("o_orderkey", "trip", N.trip_date(n).cast("string").alias("date"), N.trip_precision(n).alias("precision"), N.days_off(c, n).alias("days_off"), N.normalise_datetime(F.concat(F.lit(" "), c.cast("string"), F.lit(" 10:11:12.5+08:00"))).alias("taken"))


@query
def misfiled(t):
    rows = trip_rows(t).select("trip", F.col("o_orderkey").alias("key"), "captured", N.days_off(F.col("captured"), F.col("trip")).alias("days_off"))
    return captures.misplaced(rows).withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query
def vlm_response_parse(t):
    """Answers of a model: plain JSON, fenced JSON, names in Han characters, and nothing usable."""
    k = F.col("event_id")
    answer = F.concat(F.lit('{"category": "bird", "label": "'), F.when(k % 4 == 0, "麻雀").otherwise(F.initcap("event_type")), F.lit('", "confidence": '), (k % 100 / 100.0).cast("decimal(4,2)").cast("string"), F.lit("}"))
    content = F.when(k % 5 == 0, F.concat(F.lit("Here:\n```json\n"), answer, F.lit("\n```"))).when(k % 5 == 1, F.col("props")).when(k % 5 == 2, "sorry").otherwise(answer)
    x = L.response_fields(F.col("content"))
    return t("events").select("event_id", content.alias("content")).select("event_id", *[x[c].alias(c) for c in ("category", "label", "label_cn", "confidence", "note")])


def trees(t) -> tuple[DataFrame, DataFrame]:
    """Images and sidecars: folders are part types and sizes, stems are names with -segments."""
    k = F.col("p_partkey")
    base = F.concat(F.regexp_replace("p_name", " ", ""), F.floor(k / 7).cast("string"))
    folder = F.concat_ws("/", "p_type", (F.col("p_size") % 5).cast("string"))
    tail = F.when(k % 7 == 1, "-2").when(k % 7 == 2, "-2-3").when(k % 7 == 3, "-Enhanced-NR").when(k % 7 == 4, "-Pano").otherwise("")
    images = t("part").filter(k % 11 != 0).select(folder.alias("folder"), F.concat(base, tail).alias("stem")).distinct()
    side = t("part").filter(k % 7 < 3).select(F.when(k % 29 == 0, "unexported").otherwise(folder).alias("folder"), F.concat(base, F.when(k % 3 == 1, "-2").otherwise("")).alias("stem")).distinct()
    return images, side


@query
def claim_longest_prefix(t):
    return claims.own(*trees(t)).select("folder", "stem", "base", "owns")


@query
def unreached_sidecars(t):
    return claims.unreached(*trees(t)).select("folder", "stem")


@query
def sidecar_resolve(t):
    return claims.resolve(*trees(t))


@query
def extra_images(t):
    return claims.extras(*trees(t))


@query
def multi_claim(t):
    return claims.multi_claims(*trees(t))


@query
def tree_differences(t):
    return claims.tree_differences(*trees(t))


@query
def capture_dedup(t):
    rows = t("documents").select("doc_id", F.when(F.col("doc_id") % 19 == 0, " ").otherwise(F.md5("text")).alias("capture"))
    return captures.first_of_capture(rows, "capture", "doc_id").select("doc_id")


@query
def duplicate_groups(t):
    rows = t("documents").select(F.md5("text").alias("capture"), F.col("source").alias("trip"), (F.col("doc_id") % 4 == 0).alias("is_copy"), F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 9).alias("days_off"))
    return captures.duplicate_groups(rows).select("key", "kind", "role", "rank", "group_size")


@query
def overlay_merge(t):
    base = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    over = base.filter("o_orderkey % 10 = 0").select(F.when(F.col("o_orderkey") % 30 == 0, F.col("o_orderkey") + 100_000_000).otherwise(F.col("o_orderkey")).alias("o_orderkey"), F.when(F.col("o_orderkey") % 20 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    return merge.overlay(base, over, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def kept_rows(t) -> DataFrame:
    d = t("documents").join(t("labels"), "doc_id", "left")
    return d.select(F.col("doc_id").alias("key"), F.md5("text").alias("stem"), F.when(F.col("quality").isNotNull(), F.upper("lang")).alias("kept"), F.when(F.col("doc_id") % 3 == 0, "other").when(F.col("doc_id") % 5 == 0, "none").otherwise(F.col("lang")).alias("label"))


@query
def stale_twin_buckets(t):
    known = t("documents").join(t("labels").filter("toxic = 1"), "doc_id").select(F.col("lang").alias("label"))
    return merge.stale_buckets(kept_rows(t), known)


@query
def decisions(t):
    rows = t("labels").select(F.col("doc_id").alias("key"), F.when(F.col("toxic") == 1, "A").when(F.col("quality") == 0, "B").otherwise("C").alias("bucket"))
    said = rows.filter("key % 7 = 0").select("key", F.lit("keep").alias("decision"))
    again = rows.filter("key % 4 = 0").select("key", F.when(F.col("key") % 8 == 0, "take").otherwise("keep").alias("decision"))
    return merge.decide(rows, said, again)


@query
def tree_compare(t):
    """Documents against a changed copy: the set of their words is what matters, order and number of them are not."""
    words = lambda c: F.array_sort(F.array_distinct(F.split(c, "[ \n\t]+")))
    d = t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    again = F.concat("content", F.lit("\n"), F.split("content", "[ \n\t]+")[0])
    other = d.filter("path % 5 <> 0").select("path", F.when(F.col("path") % 3 == 0, F.concat(F.lit("!"), F.col("content"))).when(F.col("path") % 7 == 0, again).otherwise(F.col("content")).alias("content"))
    return merge.compare_trees(d, other, words(F.col("content")))


@query
def label_attach(t):
    """Orders with the last of their items' marks; some orders have none."""
    labels = t("lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("position"), F.col("l_returnflag").alias("label"))
    return merge.attach_last(t("orders").select(F.col("o_orderkey").alias("key")), labels)


@query
def run_intersection(t):
    """Keys that three runs share."""
    e = t("embeddings").select("vec_id")
    return e.filter("vec_id % 2 = 0").intersect(e.filter("vec_id % 3 = 0")).intersect(e.filter("vec_id % 5 <> 0"))


@query
def knn_1nn(t):
    return neighbours.nearest(vectors(t).select("key", "v")).select("key", F.col("other").alias("nearest"), F.round("cosine", 6).alias("cosine"))


def hits(t, dims: int | None = None) -> DataFrame:
    v = vectors(t).select("key", (F.slice("v", 1, dims) if dims else F.col("v")).alias("v"))
    return neighbours.nearest(v)


@query
def knn_score(t):
    return neighbours.scored(hits(t), vectors(t).select("key", F.col("cluster").alias("label")), 20)


@query
def quality_delta(t):
    """Agreement with the nearest neighbour per label, on all components and on the first 32."""
    own = vectors(t).select("key", F.col("cluster").alias("label"))
    by = lambda h, name: h.join(own, "key").join(own.toDF("other", "found"), "other").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("found")).cast("int")), 6).alias(name))
    both = by(hits(t), "after").join(by(hits(t, 32), "before").drop("n"), "label").filter("n >= 20")
    return both.withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


@query
def pair_similarity_stats(t):
    return clusters.pair_similarity(vectors(t))


@query
def unit_norms(t):
    return vectors(t).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.max(F.abs(norm(F.col("v")) - 1)), 5).alias("worst"))


@query
def tile_matrix(t):
    return layout.tile_matrix(in_order(t).select("position", "v"), 12)


@query
def radius_rank(t):
    return layout.radii(vectors(t)).select("cluster", "key", F.round("radius", 6).alias("radius"), "rank", "n")


@query
def effective_dimension(t):
    return layout.profile(layout.radii(vectors(t)))


@query
def radial_fits(t):
    """Of each label's radii the mode of their density, a chi fit, and whether that holds."""
    return radial.fits(layout.radii(vectors(t)))


@query
def dimension_resampled(t):
    """Effective dimensions on equal terms: 25 draws of as many vectors as the smallest label has."""
    return radial.resampled(vectors(t)).withColumn("dimension", F.round("dimension", 6))


@query
def direction_auc(t):
    """How well one direction tells the three largest labels apart, in pairs, on the half that it was not learned from."""
    v = vectors(t).select("key", F.col("cluster").alias("label"), "v")
    top = v.groupBy("label").count().orderBy(F.desc("count"), "label").limit(3)
    pairs = top.select(F.col("label").alias("first")).join(top.select(F.col("label").alias("second")), F.col("first") < F.col("second"))
    return radial.direction_auc(v, pairs, F.col("key") % 2 == 1).withColumn("auc", F.round("auc", 6))


@query
def adjacency_cos(t):
    return layout.steps(in_order(t))


@query
def adjacency_row(t):
    return layout.steps(in_order(t), gram=True)


@query
def boundary_steps(t):
    return layout.boundary_steps(layout.steps(in_order(t)))


@query
def rolling_median(t):
    """The values of all events in time, smoothed."""
    rows = order.numbered(t("events").select("event_id", "ts", "value"), "position", "ts", "event_id")
    return layout.rolling_median(rows, "value", part=2_000).select("event_id", F.round("median", 4).alias("median"))


@query
def density_clusters(t):
    """One cut of the density hierarchy at a radius where half of the vectors are dense in these tables."""
    return neighbours.density_clusters(vectors(t).select("key", "v"), 5, 1.16, 5)


@query
def hdbscan_sweep(t):
    """The vectors' clusters at three least sizes, by excess of mass."""
    found = hierarchy.sweep(vectors(t).select("key", "v"), [5, 15, 40])
    return found.withColumn("probability", F.round("probability", 6))


@query
def cluster_subdivision(t):
    """Each label's vectors clustered anew, at the size of the best validity."""
    return hierarchy.subdivided(vectors(t), [5, 10, 20])


@query
def seriate_centroids(t):
    return layout.spectral_order(vectors(t))


@query
def seriate_vectors(t):
    """All vectors in the order of the second eigenvector of their similarities."""
    v = vectors(t).select("key", normalised(F.col("v")).alias("v"))
    return spectral.image_order(v)


@query
def timeline_rank(t):
    return timeline.ranked(trip_rows(t).select(F.col("trip").alias("name")).distinct()).withColumn("date", F.col("date").cast("string"))


@query
def timeline_neighbours(t):
    return timeline.neighbours(timeline.ranked(trip_rows(t).select(F.col("trip").alias("name")).distinct()), 2)


def frames(t) -> DataFrame:
    """Line items as files of trips: a year is a group, a month of orders a trip, a part's number the file's."""
    o = t("orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("group"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("trip"), F.dayofyear("o_orderdate").cast("long").alias("pos"))
    return t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("group", "trip", "pos", F.concat("l_returnflag", F.lpad(F.col("l_partkey").cast("string"), 6, "0")).alias("key"), F.col("l_returnflag").alias("code"), F.col("l_partkey").alias("num"))


@query
def frame_collisions(t):
    return timeline.collisions(frames(t), 3).select("group", "key", "before", "pos")


@query
def trip_digest(t):
    return timeline.digest(frames(t))


@query
def segments(t):
    return timeline.segments(timeline.conflicts(frames(t)))


@query
def segments_strict(t):
    """Cut where a trip's range of numbers meets the range that its segment has covered so far, per code."""
    ranges = frames(t).groupBy("group", "pos", "code").agg(F.min("num").alias("low"), F.max("num").alias("high"))
    return timeline.segments(timeline.range_conflicts(ranges))


@query
def segment_verify(t):
    f = frames(t)
    return timeline.verify(f, timeline.segments(timeline.conflicts(f)))


def groups(t) -> DataFrame:
    """Users by number, with how many events they have."""
    counts = t("events").groupBy("user_id").agg(F.count("*").alias("size"))
    return order.numbered(counts, "position", "user_id").select(F.col("position").cast("long"), "size")


@query
def date_slots(t):
    return layout.date_slots(groups(t), 24)


@query
def next_fit(t):
    """Bins that some users' events exceed by themselves."""
    return layout.next_fit(groups(t), 60)


@query
def audit_rollup(t):
    rows = t("orders").withColumn("year", F.year("o_orderdate").cast("string"))
    return audit.rollup(rows, "year", F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query
def species_tail(t):
    return audit.tail(t("part"), "p_name", (5, 20, 50, 100))


@query
def species_top(t):
    return audit.most_common(t("part"), "p_name", 30)


@query
def pii_scan(t):
    """Findings in documents; the vocabulary is what benchmark passages begin with."""
    words = F.split("text", " ")
    names = t("benchmark").select(F.lower(F.concat_ws(" ", words[0], words[1])).alias("name")).filter(F.length("name").between(4, 59)).distinct()
    return audit.identifying(t("documents"), "text", "doc_id", user="Maria", names=names)


@query
def species_vocabulary(t):
    return audit.vocabulary(label_rows(t))


@query
def anonymise_digest(t):
    return t("part").select("p_partkey", L.tagged_digest(F.col("p_name")).alias("tag"))


@query
def mark_state(t):
    """Bits of a result's mark: what has been applied, what is missing for the next step."""
    state = F.conv(F.regexp_extract("mark", r"^C_([0-9A-F]+)$", 1), 16, 10).cast("int")
    rows = t("nation").select("n_nationkey", F.concat(F.lit("C_"), F.hex(F.col("n_nationkey").cast("long") * 3 % 32)).alias("mark")).withColumn("state", state)
    return rows.select("n_nationkey", "mark", "state", (F.col("state").bitwiseAND(3) == 3).alias("ready"), F.concat(F.lit("C_"), F.hex(F.col("state").bitwiseOR(4).cast("long"))).alias("next_mark"), F.col("state").bitwiseAND(F.bitwise_not(F.lit(7))).alias("unknown"))


@query
def report_parse(t):
    """Conversations as an indented report: a user's turn is a reason, other turns are its entries."""
    c = t("conversations")
    text = F.when(F.col("role") == "user", F.concat(F.lit("reason "), (F.col("turn") % 4).cast("string"), F.lit(" ("), F.col("turn").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("  D:\\x\\Photos-19\\a"), (F.col("turn") % 3).cast("string"), F.when(F.col("conv_id") % 2 == 0, "-Enhanced-NR").otherwise(""), F.lit(".xmp")))
    return readers.report_entries(c.select("conv_id", F.col("turn").alias("pos"), text.alias("text")), "conv_id")


@query
def flat_export_decode(t):
    names = t("pages").select(F.concat(F.when(F.col("page_id") % 9 == 0, "plain").otherwise(F.concat(F.lit("20"), F.lpad((F.col("page_id") % 25).cast("string"), 2, "0"), F.when(F.col("page_id") % 4 == 0, "x").otherwise("-06 trip"), F.lit("~~"))), F.col("page_id").cast("string"), F.lit(".jpg")).alias("name"))
    known = names.filter(F.col("name").contains("~~")).select(F.split("name", "~~")[0].alias("trip")).distinct().filter("trip like '%5-06%'").select("trip", F.lit("Photos-99").alias("library"))
    return readers.flat_names(names, known)


@query
def folder_differences(t):
    return claims.folder_differences(*trees(t))


@query
def missing_sidecars(t):
    """Sidecars without image, with what a report says of some of them, the first entry of each."""
    images, side = trees(t)
    k = F.col("p_partkey")
    base = F.concat(F.regexp_replace("p_name", " ", ""), F.floor(k / 7).cast("string"))
    entries = t("part").filter(k % 4 < 2).select(F.concat_ws("/", "p_type", (F.col("p_size") % 5).cast("string")).alias("folder"), base.alias("stem"), k.alias("pos"), F.concat(F.lit("reason "), (k % 3).cast("string")).alias("reason"), F.concat(base, F.lit(".nef")).alias("name"))
    return claims.missing(images, side, entries)


@query
def existing_images(t):
    """Sidecars whose folder and stem an image has."""
    images, side = trees(t)
    return claims.existing(side, images, "folder", "stem")


@query
def apply_decisions(t):
    rows = t("labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, "kept-existing").otherwise("csv-only").alias("applied"))
    decided = t("labels").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("key"), F.when(F.col("toxic") == 1, "take").otherwise("keep").alias("decision"))
    return merge.apply_decisions(rows, decided)


@query
def bucket_counts(t):
    """How many rows there are of each decision and bucket."""
    return QUERIES["decisions"].rows(t).groupBy("bucket", "decision").agg(F.count("*").alias("n"))


@query
def capture_groups(t):
    """Captures by their document's id, else time and frame, else time and name, that more than one row has."""
    k = F.col("l_orderkey") % 40
    rows = t("lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"), F.when(k == 0, F.concat(F.lit("id"), (F.col("l_partkey") % 50).cast("string"))).otherwise("").alias("original"),
        F.when(k == 1, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("captured"), F.when(k < 20, F.struct(F.col("l_returnflag").alias("code"), F.lpad(F.col("l_partkey").cast("string"), 6, "0").alias("num"))).alias("frame"), F.col("l_linestatus").alias("raw"),
    ).withColumn("capture", captures.capture_key(F.col("original"), F.col("captured"), F.col("frame"), F.col("raw")))
    return rows.filter("capture IS NOT NULL").groupBy("capture").agg(F.count("*").alias("n"), F.min("key").alias("first")).filter("n > 1")


@query
def density_peaks(t):
    """Members by how near their first component is to 0.1, in steps that make ties."""
    rows = in_order(t).select("cluster", "key", "position", F.round(1 - F.abs(F.col("v")[0] - 0.1), 2).alias("probability"))
    return clusters.density_peaks(rows)


@query
def label_spans(t):
    """Runs of one status along the orders."""
    rows = order.numbered(t("orders").select("o_orderkey", F.col("o_orderstatus").alias("cluster")), "position", "o_orderkey")
    return clusters.spans(rows)


@query
def adjusted_mutual_information(t):
    return clusters.adjusted_mutual_information(t("documents"), "source", "lang")


@query
def top_movers(t):
    """Parts' types by how their mean price differs between both halves of the keys."""
    half = lambda x: F.avg(F.when(F.col("p_partkey") % 2 == x, F.col("p_retailprice")))
    deltas = t("part").groupBy(F.col("p_brand").alias("label")).agg(F.round(half(0) - half(1), 4).alias("delta"))
    return audit.movers(deltas, 5).select("label", "delta", "kind", "rank")


@query
def warped_tiles(t):
    """Tiles of the vectors' order that become finer towards its end, and tiles that keep to clusters."""
    rows = in_order(t).select("position", "cluster")
    whole = layout.tile_starts(rows.sparkSession, rows.count(), 24, 0.5).select(F.lit("warp").alias("kind"), "start")
    return whole.unionByName(layout.cluster_tile_starts(clusters.spans(rows), 24, 0.5).select(F.lit("cluster").alias("kind"), "start"))


@query
def vector_fingerprints(t):
    """What must agree for vectors to lie in one file: model and image size."""
    size = F.when(F.col("vec_id") % 7 == 0, None).when(F.col("vec_id") % 7 == 1, 0).otherwise(F.col("vec_id") % 3 * 224)
    return t("embeddings").select(scope.fingerprint(F.concat(F.lit("m"), (F.col("label") % 2).cast("string")), size).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n"))


@query
def incremental_upsert(t):
    """The newest event of each user, by a stream over files that remembers where it stopped."""
    events = t("events").select("user_id", "event_id", "ts", "event_type", "value")
    folder = shared_dir(events.sparkSession)
    events.write.parquet(f"{folder}/arrivals")
    return incremental.newest(events.sparkSession, f"{folder}/arrivals", folder, "user_id", "event_id")


@query
def event_windows(t):
    """Events of each type in windows of six hours."""
    return event_time.window_counts(t("events"), "event_type", "6 hours", "1 hour")


@query
def event_sessions(t):
    """Users' sessions: events no more than two hours apart; repeated events count once."""
    e = t("events")
    twice = e.unionByName(e.filter("event_id % 7 = 0"))
    return event_time.sessions(event_time.once(twice, "event_id", "1 hour"), "user_id", "2 hours", "1 hour")


@query
def event_session_stream(t):
    """The sessions that are closed once all events have come, by a stream over files."""
    e = t("events").select("event_id", "ts", "user_id", "value")
    folder = shared_dir(e.sparkSession)
    e.unionByName(e.filter("event_id % 7 = 0")).write.parquet(f"{folder}/arrivals")
    return event_time.closed_sessions(e.sparkSession, f"{folder}/arrivals", folder, "event_id", "user_id", "2 hours", "1 hour")


@query
def pending_items(t):
    """Documents that no run has labelled."""
    return scope.pending(t("documents").select("doc_id"), t("labels").select("doc_id"), "doc_id")


@query
def frequent_names(t):
    """Parts whose first word of the name stands 20 times at least."""
    rows = t("part").select("p_partkey", F.split("p_name", " ")[0].alias("word"))
    return clusters.frequent_only(rows, "word", 20)


def answers(t) -> DataFrame:
    """Documents asked of a stand-in for a model, which fails for some for good."""

    def connect():
        def ask(items):
            if (items["doc_id"] % 97 == 0).any():
                raise connectors.Refused("no answer")
            return [(len(x or ""), "long" if len(x or "") > 500 else "short") for x in items["text"]]

        return ask

    return connectors.answered(t("documents").select("doc_id", "text"), "doc_id", connect, "n_chars int, label string", connectors.Policy(size=1, concurrent=8))


@query
def model_answers(t):
    """Answers to every document, and which of them failed."""
    return answers(t).select("doc_id", "n_chars", "label", "attempts", "error")


#: Transforms of label rows: sizes of their sources, then their order by these.
MARKS = marks.Registry(
    marks.Transform(1, "add_source_size", lambda rows: rows.join(rows.groupBy("source").agg(F.count("*").alias("source_size")), "source", "left")),
    marks.Transform(2, "order_by_size", lambda rows: order.numbered(rows, "place", F.desc_nulls_last("source_size"), F.asc_nulls_first("source"), "doc_id"), requires=1),
)


@query
def marked_order(t):
    """Documents ordered by the size of their source, which is computed first because the order needs it."""
    return MARKS.applied(t("documents").select("doc_id", "source"), "order_by_size", resolve=True)


@query
def unprocessed_worklist(t):
    """Sidecars without a label: of every third one no keywords, of some keywords of others, of one in eleven nothing that can be read."""
    images, side = trees(t)
    n = F.length("stem") + F.length("folder")
    words = F.when(n % 11 == 0, F.lit(None)).when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(F.lit("holiday"))).otherwise(F.array(F.lit("bird"), F.lit("holiday")))
    return claims.unprocessed(images, side.withColumn("keywords", words), F.filter("keywords", lambda k: k.isin(*L.CATEGORIES)))


@query
def segment_cuts(t):
    held = stored(timeline.keys_of(frames(t)), "keys")
    return timeline.cuts_of(held, timeline.segments(timeline.conflicts_of(held)))


@query
def display_order(t):
    """Labels in spectral order, their vectors from the core outwards; labels of fewer than 200 are the tail."""
    return layout.display_order(vectors(t), 200)


@query
def date_plan(t):
    """Days and slots of all users' events, in time, a user's events taking whole days of 24 slots."""
    of = t("events").groupBy("user_id").agg(F.count("*").alias("size"))
    users = order.numbered(of, "position", "user_id").withColumn("position", F.col("position").cast("long"))
    line = order.numbered(t("events").select("user_id", "ts", "event_id"), "at", "user_id", "ts", "event_id")
    first = line.groupBy("user_id").agg(F.min("at").alias("first"))
    members = line.join(first, "user_id").join(users.select("user_id", "position"), "user_id").select("event_id", "position", (F.col("at") - F.col("first") + 1).alias("rank"))
    return layout.member_slots(members, layout.date_slots(users.select("position", "size"), 24), 24)


@query
def duplicate_agreement(t):
    """Whether documents with one text agree in language and source."""
    return captures.self_agreement(t("documents").select(F.sha2("text", 256).alias("capture"), "lang", "source"), "capture", "lang", "source")
