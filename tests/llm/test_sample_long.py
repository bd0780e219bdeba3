from pyspark.sql import functions as F

from larkspar.llm.common import labelled_sample


def test_long_documents_are_learned_from_in_excerpts(spark):
    rows = [(i, ("bad " * 6000 if i % 2 else "good") + str(i), i % 2) for i in range(8)] + [(8, None, 0), (9, "é" * 9000, 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", F.lit(True), 400, 16_000)
    assert sorted(y for _, y in got) == [0] * 5 + [1] * 5
    assert all(len(t.encode()) <= 16_003 and (y == 0 or len(t) > 3_000) for t, y in got)
