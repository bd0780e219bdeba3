"""Segments by counter ranges, against the walk over the trips with a running envelope per code."""

import os
import random
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__
from larkspar.operators import timeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def strict_segments(trips):
    """trips: position -> {code: (low, high)}."""
    n, seen, out = 1, {}, {}
    for pos, ranges in sorted(trips.items()):
        if any(c in seen and seen[c][0] <= high and low <= seen[c][1] for c, (low, high) in ranges.items()):
            n, seen = n + 1, {}
        for c, (low, high) in ranges.items():
            seen[c] = (min(seen[c][0], low), max(seen[c][1], high)) if c in seen else (low, high)
        out[pos] = n
    return out


def found(spark, trips):
    rows = [("g", p, c, *r) for p, ranges in trips.items() for c, r in ranges.items()]
    df = spark.createDataFrame(rows, "group string, pos long, code string, low long, high long")
    return {r.pos: r.segment for r in timeline.segments(timeline.range_conflicts(df)).collect()}


def test_a_trip_in_the_gap_between_two_ranges_cuts(spark):
    trips = {1: {"a": (0, 10)}, 2: {"a": (90, 99)}, 3: {"a": (40, 50)}, 4: {"b": (0, 99)}, 5: {"a": (60, 61)}}
    assert found(spark, trips) == strict_segments(trips) == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2}


def test_strict_segments_are_those_of_the_walk(spark):
    r = random.Random(6)
    for wide in (1, 20, 200):
        trips = {p: {c: (low := r.randint(0, 1000), low + r.randint(0, wide)) for c in r.sample("abc", r.randint(1, 3))} for p in range(0, 120, 2)}
        assert found(spark, trips) == strict_segments(trips)


def test_limits_are_followed_up_and_down_several_levels(spark, monkeypatch):
    r = random.Random(3)
    values = {k: [r.randint(0, 50) for _ in range(150 // k)] for k in (1, 2, 50)}
    limits = [(k, at, r.randint(0, 60)) for k, v in values.items() for at in range(len(v))]
    monkeypatch.setattr(timeline, "FAN", 4)
    line = spark.createDataFrame([(k, i, x) for k, v in values.items() for i, x in enumerate(v)], "line long, at long, value long")
    found = timeline.last_reaching(line, spark.createDataFrame(limits, "line long, at long, limit long")).collect()
    want = {(k, at): max((j for j in range(at) if values[k][j] >= limit), default=None) for k, at, limit in limits}
    assert {(x.line, x.at): x.found for x in found} == want


def test_no_trips_have_no_segments(spark):
    assert timeline.range_conflicts(spark.createDataFrame([], "group string, pos long, code string, low long, high long")).collect() == []


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_the_query_takes_whole_ranges(spark):
    items, orders = (pd.read_parquet(f"{SF}/{n}.parquet") for n in ("lineitem", "orders"))
    f = items.merge(orders, left_on="l_orderkey", right_on="o_orderkey")
    day = pd.to_datetime(f["o_orderdate"]).dt
    ranges = f.assign(group=day.year, pos=day.dayofyear).groupby(["group", "pos", "l_returnflag"])["l_partkey"].agg(["min", "max"])
    want: dict = {}
    for (group, pos, code), (low, high) in zip(ranges.index, ranges.itertuples(index=False), strict=True):
        want.setdefault(group, {}).setdefault(pos, {})[code] = (low, high)
    got = __spark_entry__.queries()["segments_strict"](spark, SF).collect()
    assert {(x.group, x.pos): x.segment for x in got} == {(g, p): n for g, trips in want.items() for p, n in strict_segments(trips).items()}
