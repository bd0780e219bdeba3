"""Personal data by bootstrapped contextual extraction, in DataFrame functions throughout.

1. A text is split at its *runs*: words that hold a digit or an @, with what phone numbers have between them.  All
   base spans (email, ip, card, phone) lie within runs, so that only runs are searched for them.  Of the rest only
   lengths and the words next to a run are kept.
2. Seeds are the base spans that fill a run's core (the run without punctuation around it).  Lexical patterns are
   the words around a core: one or two before it, one behind it, one on either side.
3. Patterns and instances (cores) make a graph.  In each round a pattern is scored by the share of its instances that
   are believed to be of a kind, and by how many there are; an instance that is no base span, and whose form allows the
   kind, is believed as far as its best trusted pattern is, less in every round.
4. Cores that trusted patterns find are spans of that kind, in all their places where one of these patterns stands.

Base spans always stay.  Offsets are code points, the end excluded.  Null counts as empty.  Repeated rows and ids are texts
of their own, though equal cores are one instance.  An empty table has an empty result.  Other columns are carried
through; those that are named as a result's are replaced.  Ties between kinds go to the kind listed first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspar.llm.common import Scratch, fresh, others, stored, table, with_few, with_row_key

#: Kinds in order, and their patterns.  What comes first keeps the search linear: a match can only begin where
#: a run of such characters does, or where the match before ended; possessive loops neither backtrack nor recurse.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A run: words with a digit or an @, and between them spaces and words of brackets, dots and hyphens.
SPACE, SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
MARKED = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
RUN = rf"(?<!{SOLID}){MARKED}(?:\x20++(?:{MARKED}|[().-]++(?!{SOLID})))*+"
#: Characters of the text beside a run in which its neighbours are looked for, and the longest neighbour.
BESIDE, LONGEST = 64, 24

#: Rounds, the least number of different believed instances of a trusted pattern, its least share of these, and what belief
#: loses in each round.
ROUNDS, SUPPORT, TRUST, FADING = 4, 3, 0.8, 0.95


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit: every second from the right counts double, its digits summed."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def sound(kind: str, found: Column) -> Column:
    """Whether what the kind's pattern matched is one."""
    if kind == "ip":
        short = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(found)).between(12, 19) & luhn(F.substring(digits(found), 1, 19))
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    return F.lit(True)


def allowed(kind: str, core: Column) -> Column:
    """Whether the form of a core, which is no base span, allows the kind."""
    n = F.length(digits(core))
    if kind == "email":
        return core.rlike(rf"^{SOLID}+@{SOLID}+$")
    if kind == "ip":
        return core.rlike(r"^[0-9a-fA-F]*([.:][0-9a-fA-F]*){2,7}$") & core.rlike(r"[.:]")
    if kind == "card":
        return core.rlike(r"^[0-9](?:[\x20-]*+[0-9])*+$") & n.between(12, 19)
    return core.rlike(r"^[+(]?[0-9][\x20().0-9/-]*$") & n.between(7, 15)


def found_runs(docs: DataFrame, rest: list[T.StructField]) -> DataFrame:
    """docs as _k (a key), row (a struct of their other columns) and runs: an array of run, before and behind (text beside it) and apart (length since the run before)."""
    text = F.coalesce("text", F.lit(""))
    inner = F.struct(F.lit(0).alias(fresh(docs, "_key")), *[F.col(f"`{f.name}`") for f in rest])
    pieces = F.transform(F.split(text, RUN, -1), lambda p: F.struct(F.length(p).alias("apart"), F.right(p, F.lit(BESIDE)).alias("before"), F.left(p, F.lit(BESIDE)).alias("behind")))
    both = docs.select(inner.alias("row"), F.regexp_extract_all(text, F.lit(RUN), 0).alias("runs"), pieces.alias("pieces"))
    # One piece more than there are runs: the pieces on a run's sides are its own and the next.
    runs = F.transform("runs", lambda r, i: F.struct(r.alias("run"), F.get("pieces", i)["apart"].alias("apart"), F.get("pieces", i)["before"].alias("before"), F.get("pieces", i + 1)["behind"].alias("behind")))
    return with_row_key(both.select("row", runs.alias("runs")), "_k")


def placed(keyed: DataFrame) -> DataFrame:
    """A row for each run: its row's key, number, start in the text, run and the text beside it."""
    each = keyed.select(F.col("_k").alias("row"), F.posexplode("runs").alias("number", "r")).select("row", "number", "r.*")
    before = W.partitionBy("row").orderBy("number")
    return each.withColumn("start", F.sum(F.col("apart") + F.length("run")).over(before) - F.length("run"))


def base_spans(runs: DataFrame) -> DataFrame:
    """The base spans in runs: row, number, kind (its place in KINDS), start and end in the text, and the run's own start."""
    parts = []
    for k, kind in enumerate(KINDS):
        hits, pieces = F.regexp_extract_all("run", F.lit(PATTERNS[kind]), 0), F.split("run", PATTERNS[kind], -1)
        some = runs.filter(F.col("run").rlike(PATTERNS[kind])).select("row", "number", "start", "run", F.lit(k).alias("kind"), hits.alias("hits"), F.transform(pieces, F.length).alias("pieces"))
        each = some.select("row", "number", "start", "kind", F.posexplode(F.transform("hits", lambda h, i: F.struct(h.alias("hit"), F.get("pieces", i).alias("apart")))).alias("n", "h"))
        order = W.partitionBy("row", "number", "start", "kind").orderBy("n")
        end = F.sum(F.col("h.apart") + F.length("h.hit")).over(order)
        each = each.select("row", "number", "kind", "h.hit", (F.col("start") + end).alias("end")).withColumn("start", F.col("end") - F.length("hit"))
        parts.append(each.filter(sound(kind, F.col("hit"))).select("row", "number", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    return reduce(DataFrame.unionByName, parts)


def cores_of(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """Runs as instances: row, start, end and core, its kind if one base span fills it, whether it holds any, and its patterns."""
    lead = F.length(F.regexp_extract("run", r"^[^A-Za-z0-9+(@]*+", 0))
    core = F.regexp_replace(F.regexp_replace("run", r"^[^A-Za-z0-9+(@]++", ""), r"[^A-Za-z0-9]++$", "")
    of_run = spans.groupBy("row", "number").agg(F.min(F.struct("start", "end", "kind")).alias("first"), F.max("end").alias("last"))
    word = lambda c: F.lower(F.regexp_replace(F.substring(c, 1, LONGEST), "[0-9]", "0"))
    one, two = (F.regexp_extract("before", pattern, 1) for pattern in (rf"({SOLID}++){SPACE}*+$", rf"({SOLID}++{SPACE}++{SOLID}++){SPACE}*+$"))
    behind = F.regexp_extract("behind", rf"^{SPACE}*+({SOLID}++)", 1)
    named = lambda kind, *words: F.when(reduce(lambda a, b: a & b, [F.length(w) > 0 for w in words]), F.concat_ws(" ", F.lit(kind), *map(word, words)))
    patterns = F.array_compact(F.array(named("l", one), named("ll", two), named("r", behind), named("lr", one, behind)))
    rows = runs.withColumns({"core": core, "begin": F.col("start") + lead}).join(of_run, ["row", "number"], "left")
    fills = (F.col("first.start") == F.col("begin")) & (F.col("last") == F.col("begin") + F.length("core")) & (F.col("first.end") == F.col("last"))
    return rows.filter(F.length("core") > 0).select("row", F.col("begin").cast("long").alias("start"), (F.col("begin") + F.length("core")).cast("long").alias("end"), "core", F.when(fills, F.col("first.kind")).alias("kind"), F.col("first").isNotNull().alias("known"), patterns.alias("patterns"))


def believed(cores: DataFrame, rounds: int, support: int, trust: float, scratch: Scratch) -> DataFrame:
    """Trusted patterns (pattern, kind, score): scored on the graph of patterns and instances, round by round."""
    edges = scratch.stored(cores.select("core", F.explode("patterns").alias("pattern")).distinct(), "edges")
    # An instance is a core, whatever its places: of a kind if it is a base span; unknown if it holds none.
    forms = F.array(*[F.when(allowed(k, F.col("core")), F.lit(i)) for i, k in enumerate(KINDS)])
    instances = scratch.stored(cores.groupBy("core").agg(F.min("kind").alias("kind"), F.max("known").alias("known")).withColumn("forms", F.array_compact(forms)), "instances")
    scores = scratch.stored(instances.filter("kind IS NOT NULL").select("core", "kind", F.lit(1.0).alias("belief")), "beliefs")
    sizes = scratch.stored(edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support), "sizes")
    open_ = instances.filter(~F.col("known") & (F.size("forms") > 0)).select("core", F.explode("forms").alias("kind"))
    trusted = None
    for k in range(rounds):
        # Sums of beliefs for each pattern and kind, against all instances that it has.
        mass = with_few(edges, scores, "core").groupBy("pattern", "kind").agg(F.round(F.sum("belief"), 9).alias("mass"), F.count("*").alias("some"))
        score = F.col("mass") / (F.col("n") + 0.5)
        now = mass.filter(F.col("some") >= support).join(sizes, "pattern").select("pattern", "kind", score.alias("score")).filter(F.col("score") >= trust)
        trusted = scratch.stored(now, "trusted")
        if k == rounds - 1 or trusted.isEmpty():
            break
        best = with_few(edges, trusted, "pattern").join(open_, ["core", "kind"]).groupBy("core", "kind").agg((F.max("score") * FADING ** (k + 1)).alias("belief"))
        one = best.groupBy("core").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"), F.max("belief").alias("belief"))
        seeds = instances.filter("kind IS NOT NULL").select("core", "kind", F.lit(1.0).alias("belief"))
        scores = scratch.stored(seeds.unionByName(one), "beliefs")
    return trusted


def discovered(cores: DataFrame, trusted: DataFrame) -> DataFrame:
    """Spans (row, kind, start, end) of cores that hold no base span, stand in a trusted pattern, and whose form allows its kind."""
    forms = F.array(*[F.when(allowed(k, F.col("core")), F.lit(i)) for i, k in enumerate(KINDS)])
    open_ = cores.filter(~F.col("known")).withColumn("forms", F.array_compact(forms)).filter(F.size("forms") > 0)
    each = with_few(open_.select("row", "start", "end", "forms", F.explode("patterns").alias("pattern")), trusted, "pattern").filter(F.array_contains("forms", F.col("kind")))
    return each.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))


def personal_spans(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """docs without text, with n_email, n_ip, n_card and n_phone (base spans), base_sha256, spans, n_added and found.

    spans: ``kind:start:end`` of all spans, by start and kind, joined by commas; found: the same as an array of kind, start,
    end and base; n_added: how many of them the patterns have added.
    """
    made = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "found"]
    rest = others(docs, *made)
    keyed = found_runs(docs, rest)
    with Scratch(docs.sparkSession) as scratch:
        runs = scratch.stored(placed(keyed), "runs")
        base = scratch.stored(base_spans(runs), "base")
        cores = scratch.stored(cores_of(runs, base), "cores")
        trusted = believed(cores, rounds, support, trust, scratch)
        more = discovered(cores, trusted).select("row", "kind", "start", "end", F.lit(False).alias("base"))
        every = base.select("row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(more)
        spans = stored(every.groupBy(F.col("row").alias("_k")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("all")), "spans")  # bounded by the row's own text
    names = F.array(*map(F.lit, KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = keyed.select("_k", "row").join(spans, "_k", "left").withColumn("all", F.coalesce("all", F.array().cast(spans.schema["all"].dataType)))
    count = lambda i: F.size(F.filter("all", lambda s: s["base"] & (s["kind"] == i))).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    found = F.transform("all", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    added = F.size(F.filter("all", lambda s: ~s["base"])).cast("long")
    kept = [F.col("row").getField(f.name).alias(f.name) for f in rest]
    base_only = F.filter("all", lambda s: s["base"])
    return out.select(*kept, *counts, F.sha2(joined(base_only).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), added.alias("n_added"), found.alias("found"))


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    return personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("found")
