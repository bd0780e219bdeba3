"""Parts in one small file are dealt to several tasks before their sidecars are made."""

from larkspar.plans import catalogue


def test_sidecars_are_made_by_several_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(catalogue, "SIDECARS_PER_TASK", 50, raising=False)
    rows = spark.range(220).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand", "'STEEL' AS p_type", "int(id % 5) AS p_size", "'a b' AS p_name", "1.0D AS p_retailprice")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue.QUERIES["sidecar_scrub"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 5
    assert sorted(r.p_partkey for r in found.collect()) == list(range(220))
