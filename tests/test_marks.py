"""Transforms with prerequisites: order, refusal, and going on where a result stands."""

import pytest
from pyspark.sql import functions as F

from larkspar.operators.scope import require_one_fingerprint
from larkspar.plans.marks import Missing, Registry, Transform, state_of


def registry(log):
    def step(name):
        def apply(rows):
            log.append(name)
            return rows.withColumn(name, F.lit(len(log)))

        return apply

    return Registry(Transform(4, "c", step("c"), requires=3), Transform(1, "a", step("a")), Transform(2, "b", step("b"), requires=1), Transform(8, "d", step("d")))


def test_prerequisites_are_applied_in_order_or_refused(spark):
    log, rows = [], spark.range(2).toDF("id")
    r = registry(log)
    with pytest.raises(Missing, match="c needs a, b first; applied: nothing"):
        r.applied(rows, "c")
    done = r.applied(rows, "c", resolve=True)
    assert log == ["a", "b", "c"] and done.columns == ["id", "a", "b", "c", "C_7"] and state_of(done) == (7, "C_7")
    assert r.applied(done, "b").columns == done.columns and log == ["a", "b", "c"]
    r.applied(done, "b", force=True)
    assert log == ["a", "b", "c", "b"]
    assert r.applied(done, "d").columns == ["id", "a", "b", "c", "d", "C_F"]


def test_a_stored_result_goes_on_where_it_stands(spark, tmp_path):
    log = []
    r = registry(log)
    r.applied(spark.range(3).toDF("id"), "a").write.parquet(f"{tmp_path}/x")
    again = r.applied(spark.read.parquet(f"{tmp_path}/x"), "c", resolve=True)
    assert log == ["a", "b", "c"] and again.count() == 3
    newer = spark.range(1).withColumn("C_21", F.lit(""))
    assert r.described(state_of(newer)[0]) == "a (+ unknown bits 0x20)" and r.applied(newer, "b").columns == ["id", "b", "C_23"]


def test_bits_that_cannot_be(spark):
    same = lambda rows: rows
    for bad in ([Transform(3, "x", same)], [Transform(1, "x", same), Transform(1, "y", same)], [Transform(1, "x", same, requires=2), Transform(2, "y", same)], [Transform(2, "x", same, requires=1)]):
        with pytest.raises(ValueError):
            Registry(*bad)


def test_vectors_of_two_models_are_refused(spark):
    rows = spark.createDataFrame([("m@1",), ("m@1",)], "f string")
    require_one_fingerprint(rows, "f")
    with pytest.raises(ValueError, match="more than one"):
        require_one_fingerprint(rows.unionByName(spark.createDataFrame([("n@1",)], "f string")), "f")
