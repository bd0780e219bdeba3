import math
import random

from pyspark.sql import functions as F

from larkspar.llm import op08_topk
from larkspar.llm.op08_topk import top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def rows(seed=1):
    r = random.Random(seed)
    out = [(i, [r.uniform(-1, 1) for _ in range(8)], "x") for i in range(150)]
    out += [(i, out[3][1], "x") for i in range(200, 260)]  # many equal vectors
    return out + [(300, None, "x"), (301, [1.0, None] * 4, "x"), (302, [math.nan] * 8, "x"), (303, [math.inf] * 8, "x"), (None, out[0][1], "x"), (400, [0.5, 0.5], "x"), (410, [0.1, 0.2], "x"), (20, out[5][1], "x")]


def by_hand(data, k):
    import numpy as np

    ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % 10 == 0:
            scores = sorted((-int(a @ b), c) for m, (c, b) in enumerate(ok) if m != n and len(a) == len(b))[:k]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores, 1)]
    return sorted(out)


def test_matches_sorting_all_scores(spark, monkeypatch):
    data = rows()
    for sizes in ((4096, 16384, 4096), (4, 9, 16)):
        for name, value in zip(("QUERY_BLOCK", "CANDIDATE_BLOCK", "BINS"), sizes, strict=True):
            monkeypatch.setattr(op08_topk, name, value)
        if sizes[2] != 4096:
            monkeypatch.setattr(op08_topk, "BINS", 4096)  # the tasks have their own copy of the module
        for k in (3, 500):
            got = top_k(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 10 == 0, k).collect()
            assert sorted(tuple(r) for r in got) == by_hand(data, k)


def test_empty_table_and_large_components(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), F.lit(True), 3).count() == 0
    data = [(i, [1e4 * i, -2e4, 3.5e3 + i], "x") for i in range(30)]
    huge = spark.createDataFrame([(0, [3e38, 1.0], "x"), (1, [3e38, -3e38], "x")], SCHEMA)
    assert top_k(huge, F.lit(True), 4).count() == 2  # scores beyond a long have no meaning, but do not fail
    got = top_k(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 10 == 0, 4).collect()
    assert sorted(tuple(r) for r in got) == by_hand(data, 4)


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(i, [float(i), 1.0], 7, "b", 3, 9) for i in range(5)], "vec_id long, embedding array<float>, query_id int, block string, RANK int, q long")
    got = top_k(docs, F.col("vec_id") % 2 == 0, 2)
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r.query_id, r.vec_id) for r in got.collect() if r.rank == 1) == [(0, 1), (2, 4), (4, 3)]
