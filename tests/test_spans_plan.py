"""Rows that meet by their positions are not shipped whole, however small their files are."""

import re

from larkspar.operators import clusters, order


def shipped(df, capsys):
    df.explain()
    return len(re.findall("BroadcastHashJoin .*LeftOuter", capsys.readouterr().out))


def test_spans_do_not_ship_rows(spark, capsys):
    rows = order.numbered(spark.range(2_000).selectExpr("id", "id div 7 % 3 AS cluster"), "position", "id")
    found = clusters.spans(rows)
    assert shipped(found, capsys) == 0
    got = sorted((r.begin, r.end, r.cluster) for r in found.collect())
    assert got == [(7 * i + 1, min(7 * i + 7, 2_000) + 1, i % 3) for i in range(286)]


def test_neighbours_in_order_do_not_ship_rows(spark, capsys):
    rows = order.numbered(spark.range(50).toDF("x"), "position", "x")
    found = order.neighbour(rows, "position", ["x"])
    assert shipped(found, capsys) == 0
    assert [r.next_x for r in found.orderBy("position").collect()] == [*range(1, 50), None]
