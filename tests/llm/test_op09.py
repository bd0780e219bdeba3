import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larkspar.llm import op09_mixing
from larkspar.llm.op09_mixing import mix, mixture

SCHEMA = "doc_id long, text string, source string, copies string"


def rows():
    r = random.Random(3)
    out = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(1, 30))), s, "c") for i, s in enumerate(["big"] * 300 + ["mid"] * 80 + ["small"] * 20 + [None] * 30)]
    return out + [(None, "a b", "big", "c"), (1000, None, "big", "c"), (1001, "", "bare", "c"), (1, "x y", "mid", "c"), (1, "x y", "mid", "c")]


def words(t):
    return len((t or "").split())


def totals(data):
    t = defaultdict(int)
    for _, text, s, _ in data:
        t[s] += words(text)
    return t


def weights(t, a):
    x = {s: (n / sum(t.values())) ** a for s, n in t.items() if n}
    return {s: v / sum(x.values()) for s, v in x.items()}


def bisected(ok):
    low, high = 0.0, 1.0
    for _ in range(60):
        m = (low + high) / 2
        low, high = (m, high) if ok(m) else (low, m)
    return low


@pytest.mark.parametrize("block", [20_000, 7])
def test_weights_budget_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(op09_mixing, "BLOCK_ROWS", block)
    data, t = rows(), totals(rows())
    target = 1.6
    a = bisected(lambda a: -sum(w * math.log2(w) for w in weights(t, a).values()) >= target)
    got = mix(spark.createDataFrame(data, SCHEMA), target_entropy=target, budget=3_000).collect()
    assert len(got) == len(data)
    for s, w in weights(t, a).items():
        of = [r for r in got if r.source == s]
        assert all(abs(r.weight - w) < 1e-6 for r in of)
        taken = sum(r.n_tokens * r.copies for r in of)
        counts = {r.copies for r in of if r.n_tokens}
        assert max(counts) - min(counts) <= 1 and round(w * 3_000) - 31 <= taken <= round(w * 3_000) + 1


def test_repetition_limit_loses_no_document(spark):
    data, t = rows(), totals(rows())
    got = mix(spark.createDataFrame(data, SCHEMA), max_repetition=2.0).collect()
    assert all(r.copies >= 1 for r in got) and max(r.copies for r in got) <= 2
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.copies * r.n_tokens
    smallest = min((n, s) for s, n in t.items() if n)[1]
    assert taken[smallest] >= 1.9 * t[smallest] and abs(taken["big"] - t["big"]) <= 1


def test_permutations_depend_on_the_seed_only(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    pick = lambda seed: {(r.doc_id, r._row): r.copies for r in mix(docs, target_entropy=1.6, budget=1_500, seed=seed).collect()}
    assert pick(1) == pick(1) != pick(2)


def test_places_are_block_permutations(spark, monkeypatch):
    monkeypatch.setattr(op09_mixing, "BLOCK_ROWS", 7)
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mixture(docs, target_entropy=1.6, budget=3_000, places=True).collect()
    assert len({(r.source, r.place) for r in got}) == len(got)
    for s in {r.source for r in got}:
        of = sorted((r for r in got if r.source == s), key=lambda r: r.place)
        passes = [r.place["pass"] for r in of]
        blocks = [(r.place["pass"], r.place.block.block) for r in of]
        # Passes follow each other, and the rows of a block stand together.
        assert passes == sorted(passes) and len(set(blocks)) == 1 + sum(a != b for a, b in zip(blocks, blocks[1:], strict=False))


def test_empty_and_wordless_tables_and_columns(spark):
    assert mix(spark.createDataFrame([], SCHEMA), max_repetition=2.0).count() == 0
    bare = spark.createDataFrame([(1, None, "a", "c"), (2, " ", "b", "c")], SCHEMA)
    assert [r.copies for r in mix(bare, max_repetition=2.0).collect()] == [1, 1]
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = mixture(docs, max_repetition=2.0)
    assert out.columns == docs.columns and len(rows()) < out.count() <= 2 * len(rows())
    clash = docs.withColumns({"_row": F.lit(1), "n_tokens": F.lit("x"), "place": F.lit("y"), "weight": F.lit(0)})
    assert mixture(clash, max_repetition=2.0).columns == clash.columns and mixture(clash, max_repetition=2.0).select("_row", "n_tokens", "place").first() == (1, "x", "y")
    with pytest.raises(ValueError, match="either"):
        mix(docs)
