"""The next known value in line: right in parts and over them, by frames that grow."""

from larkspar.operators import layout


def test_next_known_values_by_growing_frames(spark, capsys):
    values = [None, 3, None, None, 5, None, None, None, None, 7, None]
    rows = spark.createDataFrame(list(enumerate(values, 1)), "at long, x long").repartition(3)
    for part in (1, 3, 4, 100):
        found = layout.next_known(rows, "at", "x", part)
        assert [r.found for r in found.orderBy("at").collect()] == [3, 5, 5, 5, 7, 7, 7, 7, 7, None, None]
    found.explain(True)
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()  # read anew for each row: quadratic in a part
