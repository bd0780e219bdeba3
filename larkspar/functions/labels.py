"""Label strings, keywords and confidences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The categories of a label, now and in the earliest generation, the marker of a photo without bird, the
# ending of a machine's label, and the beginning of a label that was written by hand.
CATEGORIES = ("bird", "animal", "people", "scenery")
EARLY_CATEGORIES = ("People", "Unknown")
NO_BIRD_MARKER = "_nb"
CONFIDENCE_ENDING = r"^_?.+\(\d{1,3}%\)$"
HAND_WRITTEN = r"^[A-Za-z]+-\s*[^-]*[一-鿿]"
LABEL = r"^([^-]+)-([^-]+)-(.+)\((\d+)%\)$"

# The letters that a syllable of Mandarin begins with, the sign that a collation by reading puts before its index
# letters, and the first Han character that such a collation orders without a reading.
SYLLABLES = "ABCDEFGHJKLMNOPQRSTWXYZ"
INDEX_SIGN = "\ufdd0"
UNREAD = "\U00020000"
#: Characters of names that are read otherwise than alone: 长 (long) in names of animals.
READINGS = {"长": "c"}


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_label(text: Column) -> Column:
    """initials-native-english(NN%) as a struct (initials, native, english, confidence); null where it has another form."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, LABEL, i)
    parsed = F.struct(F.trim(part(1)).alias("initials"), F.trim(part(2)).alias("native"), F.lower(F.trim(part(3))).alias("english"), (F.try_to_number(part(4), F.lit("999999999")).cast("double") / 100).alias("confidence"))
    return F.when(t.rlike(LABEL), parsed)


def percent(confidence: Column) -> Column:
    """A confidence in whole percents, halves to even."""
    return F.bround(confidence * 100, 0).cast("int")


def make_label(category: Column, english: Column, native: Column, initials: Column, confidence: Column) -> Column:
    """The keyword of a prediction: with native name for living beings; a leading _ marks low confidence."""
    tail = F.concat(F.lit("("), percent(confidence).cast("string"), F.lit("%)"))
    body = F.when(category.isin("bird", "animal") & (F.coalesce(native, F.lit("")) != ""), F.concat(initials, F.lit("-"), native, F.lit("-"), english, tail)).otherwise(F.concat(english, tail))
    return F.when(confidence <= 0.2, F.concat(F.lit("_"), body)).otherwise(body)


def pinyin_initials(name: Column, readings: dict[str, str] | None = None) -> Column:
    """The first letters of the readings of a name's Han characters; what has no reading stays as it is, in lower case.

    The Chinese collation orders characters by their reading, with an index letter before the first of each; the letter is found by
    bisection.  A character with several readings has the first of them, or else its letter in ``readings`` (default: READINGS).
    """
    key = lambda c: F.collate(c, "zh")
    own = F.create_map(*[F.lit(x) for pair in (READINGS if readings is None else readings).items() for x in pair] or [F.lit(""), F.lit("")])

    def letter(c: Column, among: str) -> Column:
        if len(among) == 1:
            return F.lit(among.lower())
        half = len(among) // 2
        return F.when(key(c) < key(F.lit(INDEX_SIGN + among[half])), letter(c, among[:half])).otherwise(letter(c, among[half:]))

    def initial(c: Column) -> Column:
        read = c.rlike(r"\p{IsHan}") & (key(c) < key(F.lit(UNREAD)))
        return F.coalesce(F.try_element_at(own, c), F.when(read, letter(c, SYLLABLES)), c)

    return F.lower(F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"(?s)."), F.lit(0)), initial), ""))


def initials_label(name: Column, confidence: Column) -> Column:
    """initials (NN.NN%) of a name; a confidence up to 1 is a share, a larger one a percentage."""
    scaled = F.when(confidence.between(0, 1), confidence * 100).otherwise(confidence)
    return F.concat(pinyin_initials(name), F.lit(" ("), F.call_function("format_number", scaled.cast("double"), F.lit("0.00")), F.lit("%)"))


def is_machine_keyword(word: Column, keywords: Column) -> Column:
    """Whether a keyword was written by a labelling run: a category, the marker, or a label of any generation.

    The earliest labels have no ending: beside a category, a phrase that was not written by hand is one.
    """
    text = F.trim(word)
    has_category = F.exists(keywords, lambda k: k.isin(*CATEGORIES, *EARLY_CATEGORIES))
    return text.isin(*CATEGORIES, *EARLY_CATEGORIES, NO_BIRD_MARKER) | text.rlike(CONFIDENCE_ENDING) | (has_category & text.contains(" ") & ~text.rlike(HAND_WRITTEN))


def split_keywords(keywords: Column) -> tuple[Column, Column]:
    """(ours, theirs): keywords written by labelling runs, and all others, in order."""
    return F.filter(keywords, lambda k: is_machine_keyword(k, keywords)), F.filter(keywords, lambda k: ~is_machine_keyword(k, keywords))


def merge_keywords(theirs: Column, *new: Column) -> Column:
    """theirs, then those of the new keywords that are not among them."""
    return F.concat(theirs, F.filter(F.array(*new), lambda k: k.isNotNull() & ~F.array_contains(theirs, k)))


def merge_paths(existing: Column, ours: Column, new: Column) -> Column:
    """Hierarchical keyword paths without those whose leaf is ours, then the new ones that are not there."""
    kept = F.filter(existing, lambda p: ~F.array_contains(ours, F.element_at(F.split(p, r"\|"), -1)))
    return F.concat(kept, F.filter(new, lambda p: ~F.array_contains(kept, p)))


def existing_category(keywords: Column) -> Column:
    """The first of the keywords that is a category; empty if none is."""
    return F.coalesce(F.get(F.filter(keywords, lambda k: F.trim(k).isin(*CATEGORIES, *EARLY_CATEGORIES)), F.lit(0)), F.lit(""))


def prior_labels(keywords: Column) -> Column:
    """What earlier runs left among the keywords, as a struct (category, label): the rest of theirs is joined by ;."""
    ours, _ = split_keywords(keywords)
    category = existing_category(ours)
    return F.struct(category.alias("category"), F.array_join(F.filter(ours, lambda k: k != category), ";").alias("label"))


def effective_keyword(label: Column, native: Column, initials: Column, confidence: Column, applied: Column, prior_category: Column, prior_label: Column) -> Column:
    """The keyword that holds for a label row: the prior label as it stands where the run left it in place, else its own.

    Null without a label, with a confidence that is no number, or where no part of the prior label has the form of one.
    """
    kept = (applied == "kept-existing") & (F.coalesce(prior_category, F.lit("")) != "")
    prior = F.get(F.filter(F.transform(F.split(F.coalesce(prior_label, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p.rlike(LABEL)), F.lit(0))
    english, own = F.lower(F.trim(F.coalesce(label, F.lit("")))), F.trim(F.coalesce(native, F.lit("")))
    number = F.when(F.coalesce(confidence, F.lit("")) == "", F.lit(0.0)).otherwise(confidence.try_cast("double"))
    body = F.when(own == "", english).otherwise(F.concat(initials, F.lit("-"), own, F.lit("-"), english))
    made = F.when((english != "") & number.isNotNull(), F.concat(body, F.lit("("), percent(number).cast("string"), F.lit("%)")))
    return F.when(F.coalesce(kept, F.lit(False)), prior).otherwise(made)


def effective(category: Column, label: Column, confidence: Column, applied: Column, prior_category: Column, prior_label: Column) -> Column:
    """A struct (category, species, confidence) that holds: the prior label where the run left it in place."""
    kept = (applied == "kept-existing") & (F.coalesce(prior_category, F.lit("")) != "")
    parts = F.split(F.coalesce(prior_label, F.lit("")), ";")
    prior = F.get(F.filter(F.transform(parts, parse_label), lambda p: p.isNotNull()), F.lit(0))
    own = F.struct(F.lower(F.trim(category)).alias("category"), empty_to_null(F.lower(F.trim(label))).alias("species"), F.coalesce(confidence.try_cast("double"), F.lit(0.0)).alias("confidence"))
    old = F.struct(F.lower(F.trim(prior_category)).alias("category"), prior["english"].alias("species"), prior["confidence"].alias("confidence"))
    return F.when(F.coalesce(kept, F.lit(False)), old).otherwise(own)


def response_fields(content: Column) -> Column:
    """A model's answer as a struct (category, label, label_cn, confidence, note), from JSON or the first braces of a text.

    Han characters in the label move to label_cn; what is missing gets the defaults of an unknown scene.
    """
    schema = "category string, label string, label_cn string, confidence double, note string"
    braces = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(braces != "", braces), schema)
    label = F.lower(F.trim(F.coalesce(parsed["label"], F.lit(""))))
    han = label.rlike(r"[一-鿿]")
    native = F.coalesce(parsed["label_cn"], F.lit(""))
    return F.struct(
        F.coalesce(empty_to_null(parsed["category"]), F.lit("scenery")).alias("category"),
        F.when(han | (label == ""), F.lit("unknown")).otherwise(label).alias("label"),
        F.when(han & (native == ""), label).otherwise(native).alias("label_cn"),
        F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(parsed["note"], F.lit("")).alias("note"),
    )


def share(n: Column, of: Column) -> Column:
    """n of ``of`` as a percentage with two places, or - of nothing."""
    return F.when(of == 0, F.lit("-")).otherwise(F.concat(F.format_string("%.2f", n * 100 / of), F.lit("%")))


def tagged_digest(name: Column) -> Column:
    """A stable stand-in for a name."""
    return F.concat(F.lit("sp-"), F.substring(F.sha2(name, 256), 1, 4))
