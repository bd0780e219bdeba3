import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larkspar.llm import op10_language
from larkspar.llm.common import flat
from larkspar.llm.op10_language import Languages, identify, letters, sample

SYLLABLES = {"aa": ["ka", "no", "mi", "ru"], "bb": ["sch", "ung", "lich", "ä"], "cc": ["ción", "que", "los", "ñ"]}


def text(lang, r, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def phrases(sample_, s):
    """Greedy longest phrases that occur in the sample; a symbol that does not occur is one."""
    n = i = 0
    while i < len(s):
        k = 1
        while i + k < len(s) and s[i : i + k + 1] in sample_ and s[i : i + k] in sample_:
            k += 1
        n, i = n + 1, i + k
    return n


def test_parses_like_substring_search(monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(op10_language, "STRETCH", 40)
    samples = {k: text(k, r, 60).encode() for k in SYLLABLES}
    model = Languages.learn(samples)
    some = [text(r.choice(list(SYLLABLES)), r, r.randint(0, 60)) + r.choice(["", "zq", " zz"]) for _ in range(50)] + ["", "x"]
    raw, at = flat(pa.array(some))
    got = model.entropies(raw, at)
    clean, where = letters(raw, at)
    for i in range(len(some)):
        s = clean[where[i] : where[i + 1]].tobytes()
        for j, k in enumerate(model.names):
            if s:
                want = phrases(samples[k], s) * math.log2(len(samples[k]) + 2) / len(s)
                assert abs(got[i, j] - want) < 1e-9
            else:
                assert math.isnan(got[i, j])


def test_letters_keep_single_spaces():
    raw, at = flat(pa.array(["  ab, c1d!", "", "...", "é x", None]))
    clean, where = letters(raw, at)
    assert [clean[a:b].tobytes().decode() for a, b in zip(where[:-1], where[1:], strict=True)] == [" ab c d", "", "", "é x", ""]


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(8)
    rows = [(i, text(lang, r, r.randint(5, 80)), lang, "s") for i, lang in enumerate(r.choices(list(SYLLABLES), k=300))]
    docs = spark.createDataFrame([*rows, (900, None, "aa", "s"), (901, "", None, "s"), (902, "12 !?", "aa", "s"), (None, "KANO MIRU KAKANO", None, "s"), (903, text("bb", r, 60_000), None, "s")], "doc_id long, text string, lang string, score_ string")
    model = Languages.learn(sample(docs, F.col("doc_id") % 3 != 1))
    got = {x.doc_id: x for x in identify(docs, model).collect()}
    fresh = [x for i, x in got.items() if i is not None and i < 900 and i % 3 == 1]
    assert np.mean([x.lang_pred == x.lang for x in fresh]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= x.score <= 1 for x in got.values()) and got[900].score == 0


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = Languages.learn(sample(docs, F.lit(True)))
    assert identify(docs, model).first().lang_pred == "und"
    assert identify(docs.filter("doc_id = 2"), model).count() == 0


def test_names_that_clash_and_repeated_ids(spark):
    r = random.Random(4)
    rows = [(7, text("aa", r, 40), "aa", 0.5, "x", 1) for _ in range(500)] + [(8, text("bb", r, 40), "bb", 0.5, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE double, lang_pred string, _lower int")
    learned = sample(docs, F.lit(True))
    assert len(learned["aa"]) < 2_000  # one text of the id that stands 500 times
    got = identify(docs, Languages.learn(learned))
    assert got.columns == ["doc_id", "text", "lang", "_lower", "lang_pred", "score"] and all(x.lang_pred == x.lang and x._lower == 1 for x in got.collect())
    assert identify(docs.limit(0), Languages.learn(learned)).count() == 0
