"""Keywords by who wrote them, and lines of text by what they give away."""

import pytest
from pyspark.sql import functions as F

from larkspar.functions import labels as L
from larkspar.operators import audit, layout

KEYWORDS = [
    (["bird", "dhbo-大黑背鸥-great black-backed gull(95%)"], [0, 1]),
    (["mountain landscape with glacier", "scenery"], [0, 1]),
    (["gycl- Andean Motmot-高原翠鴗", "add=20231014", "Rivertown"], []),
    (["Rivertown", "person playing tennis(98%)", "_nb"], [1, 2]),
    (["bird", "Family", "two birds on a wire", "xs-小隼-Kestrel of the north"], [0, 2]),
    (["People", "group of hikers", "jx"], [0, 1]),
    ([" bird ", "a phrase"], [0]),  # the category must stand as it is for phrases to be claimed
    ([], []),
]


def test_keywords_of_all_generations(spark):
    rows = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(KEYWORDS)], "i int, k array<string>")
    ours, theirs = L.split_keywords(F.col("k"))
    for r in rows.select("i", "k", ours.alias("ours"), theirs.alias("theirs")).collect():
        mine = KEYWORDS[r.i][1]
        assert r.ours == [r.k[j] for j in mine] and r.theirs == [k for j, k in enumerate(r.k) if j not in mine]


LINES = {
    "| 2023-10-05 Lake Tahoe | 120 |": "trip folder name",
    "2021-05-07~08 Rivertown walk": "trip folder name",
    "2023-10-05 福州": "trip folder name",
    "Photos-24 was scanned": "image key or path",
    "see _D8S7785-2.XMP": "image key or path",
    "at 40,26.7717N": "GPS",
    "GPSLatitude is absent": "GPS",
    "38.9637, -119.9403": "GPS",
    "SerialNumber: 6001234": "camera serial",
    "/home/someone/data": "home directory path",
    "a 小隼 here": "CJK text",
    "by Maria today": "photographer's name",
    "one Great Tit there": "species name",
    "Raised 2026-08-21 by someone": None,
    "Settled 2026-08-12, after a while": None,
    "2023-10-05": None,
    "Generated by Photos-24": None,
    "smew alone": None,
}


def test_lines_that_identify(spark):
    docs = spark.createDataFrame([(1, "\n".join(LINES)), (2, None), (3, "")], "doc long, text string")
    names = spark.createDataFrame([("great tit",), ("little owl",)], "name string")
    got = audit.identifying(docs, "text", "doc", user="maria", names=names).collect()
    found = {(r.line, r.kind) for r in got}
    want = {(i, kind) for i, kind in enumerate(LINES.values(), 1) if kind}
    assert want <= found and {line for line, _ in found} == {line for line, _ in want}
    capped = audit.identifying(docs, "text", "doc", names=names, per_key=1).groupBy("kind").count()
    assert all(r["count"] == 1 for r in capped.collect())


def test_vocabulary_of_birds(spark):
    rows = [("bird", "", "Smew", "dd-小-great tit(90%);old free text(20%)"), ("Scenery", "", "a garden with trees", ""), ("scenery", " Bird", "x", "little owl"), ("bird", None, None, None)]
    got = audit.vocabulary(spark.createDataFrame(rows, "category string, prior_category string, label string, prior_label string"))
    assert {r.name for r in got.collect()} == {"great tit", "old free text", "little owl"}


@pytest.mark.parametrize("n", [200, 1_301])
def test_rolling_median_goes_on_at_the_ends(spark, n):
    import numpy as np

    x = np.random.default_rng(n).random(n)
    rows = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(x)], "position long, value double")
    got = [r.median for r in layout.rolling_median(rows, "value", part=100).orderBy("position").collect()]
    k = max(5, n // 200)
    padded = np.pad(x, (k // 2, k - k // 2 - 1), mode="edge")
    assert got == ([None] * n if n <= 200 else [float(np.median(padded[i : i + k])) for i in range(n)])
