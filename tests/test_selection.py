"""Which images a label run names: every outcome, with nulls, blanks and repeated rows."""

from pyspark.sql import functions as F

from larkspar.functions import names as N
from larkspar.operators import scope

ROWS = [
    (1, "Photos-19/a/x.jpg", "Bird ", "Smew", "0.9", "written", "", "", "resolved"),
    (1, "Photos-19/a/x.jpg", "Bird ", "Smew", "0.9", "written", "", "", "resolved"),
    (2, " ", "bird", "smew", "0.9", "written", "", "", "no_image_path"),
    (3, None, None, None, None, None, None, None, "no_image_path"),
    (4, "Photos-19/b/x.jpg", "bird", "smew", "0.9", "written", "", "", "filtered_out"),
    (5, "Photos-19/a/y.jpg", "scenery", "lake", "0.9", "written", "", "", "not_selected"),
    (6, "Photos-19/a/z.jpg", "scenery", "lake", "0.9", "kept-existing", "Bird", "odd;bq-秋-smew(95%)", "resolved"),
    (7, "Photos-19/a/u.jpg", "bird", "smew", "none", "written", "", "", "below_min_confidence"),
    (8, "Photos-19/a/v.jpg", "scenery", "lake", "0.1", "kept-existing", "bird", "no label", "missing_image"),
    (9, "other/w.jpg", "bird", None, "1", "written", "", "", "resolved"),
    (10, "Photos-19/a/t.jpg", None, None, None, None, None, None, "not_selected"),
]


def selected(spark, rows, categories):
    df = spark.createDataFrame(rows, "id int, jpg string, category string, label string, confidence string, applied string, prior_category string, prior_label string, want string")
    images = spark.createDataFrame([(p,) for p in ("Photos-19/a/x.jpg", "Photos-19/a/x.jpg", "Photos-19/a/z.jpg", "Photos-19/a/u.jpg", "other/w.jpg", "Photos-19/a/y.jpg")], "path string")
    return scope.select_images(df, images, spark.createDataFrame([], "path string"), spark.createDataFrame([("Photos-19/b",)], "path string"), categories, 0.25)


def test_every_row_has_its_outcome(spark):
    rows = selected(spark, ROWS, ["bird"])
    found = rows.collect()
    assert len(found) == len(ROWS) and all(r.outcome == r.want for r in found)
    six = next(r for r in found if r.id == 6)
    assert (six.species, six.sure, six.library, six.trip, six.stem, six.year) == ("smew", 0.95, "Photos-19", "a", "z", "2019")
    counts = {(r.counter, r.value): r.n for r in scope.selection_counts(rows).collect()}
    want = {"rows": 11, "no_image_path": 2, "filtered_out": 1, "below_min_confidence": 1, "missing_image": 1, "resolved": 4, "in_scope": 8, "selected": 6, "species": 1}
    assert counts == {**{(k, None): n for k, n in want.items()}, ("category", "bird"): 6, ("year", "2019"): 3, ("year", None): 1}


def test_no_categories_take_all_and_no_rows_give_none(spark):
    counts = {(r.counter, r.value): r.n for r in scope.selection_counts(selected(spark, ROWS, None)).collect()}
    assert counts["selected", None] == 8 and counts["category", "scenery"] == 1 and counts["category", "none"] == 1
    assert [tuple(r) for r in scope.selection_counts(selected(spark, ROWS[:0], ["bird"])).collect()] == [("species", None, 0)]


def test_years_of_folders(spark):
    rows = spark.createDataFrame([("Photos-19",), ("2021",), ("a-b-07",), ("x-old",)], "f string")
    assert [r.y for r in rows.select(N.year_label(F.col("f")).alias("y")).collect()] == ["2019", "2021", "2007", "old"]
