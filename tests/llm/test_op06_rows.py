import numpy as np

from larkspar.llm import op06_jaccard


def test_short_near_copies_meet_in_blocks_of_few_rows(spark, monkeypatch):
    whole = op06_jaccard.overlaps

    def bounded(values, at, needed, alive):
        if len(at) - 1 > 3_000:
            raise MemoryError(f"{len(at) - 1} rows in one product")
        return whole(values, at, needed, alive)

    monkeypatch.setattr(op06_jaccard, "overlaps", bounded)
    n = 6_000
    notice = " ".join(f"word{i}" for i in range(19))
    # 18 shingles of two words that all share, and one of its own: J = 18 / 20
    docs = spark.range(n).selectExpr("id AS doc_id", f"concat('{notice} no', id) AS text")
    rows = op06_jaccard.jaccard_components(docs, 2, 90).toPandas()
    assert len(rows) == n and np.all(rows["component_id"] == 0) and np.all(rows["n_links"] == n - 1)
