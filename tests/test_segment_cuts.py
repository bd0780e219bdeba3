"""Cuts of segments read the frames once."""

import re

from larkspar.operators import timeline
from larkspar.plans import catalogue


def tables(spark, folder):
    spark.range(400).selectExpr("id AS o_orderkey", "date_add(date '1995-01-01', int(id % 90)) AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    spark.range(1_600).selectExpr("id div 4 AS l_orderkey", "id * 7919 % 300 AS l_partkey", "'A' AS l_returnflag").write.parquet(f"{folder}/lineitem.parquet")


def test_tables_are_joined_once(spark, tmp_path, capsys):
    tables(spark, tmp_path)
    found = catalogue.QUERIES["segment_cuts"](spark, str(tmp_path))
    found.explain()
    assert not re.findall("l_orderkey|o_orderkey", capsys.readouterr().out)
    frames = catalogue.frames(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")).collect()
    held = {}
    for r in frames:
        held.setdefault(r.pos, set()).add(r.key)
    # The walk: a segment ends before the first trip that holds one of its keys.
    owner, segment, cuts = {}, 1, []
    for pos in sorted(held):
        if met := held[pos] & owner.keys():
            segment += 1
            cuts += [(segment, pos, key, owner[key]) for key in met]
            owner = {}
        owner |= dict.fromkeys(held[pos], pos)
    assert len(cuts) > 20 and sorted((r.segment, r.pos, r.key, r.owner) for r in found.collect()) == sorted(cuts)


def test_the_first_owner_of_the_segment_before(spark):
    frames = spark.createDataFrame([("g", p, k) for p, k in [(1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "b"), (5, "a")]], "group string, pos long, key string")
    parts = spark.createDataFrame([("g", 1, 1), ("g", 2, 1), ("g", 3, 2), ("g", 4, 3), ("g", 5, 4)], "group string, pos long, segment long")
    assert sorted(map(tuple, timeline.cuts(frames, parts).collect())) == [("g", 2, 3, "a", 1), ("g", 3, 4, "b", 3)]
