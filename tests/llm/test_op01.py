import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larkspar.llm.op01_exact_dedup import deduplicate, keep_in_state, kept_rows, sha256

SCHEMA = "doc_id long, text string, lang string, keep_id string"
ROWS = [(1, "a", "x", "k"), (2, "a", None, "k"), (3, None, "x", "k"), (4, "", "x", "k"), (None, "a", "x", "k"), (5, "b" * 300_000, "x", "k"), (6, "b" * 300_000, "x", "k"), (7, " a", "x", "k"), (2, "a", "y", "k"), (8, "é", "x", "k")]


def by_hand(rows, so_far=None):
    groups = defaultdict(list)
    for r in so_far or rows:
        groups[r[1] or ""].append(r[0])
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((r[0], largest[r[1] or ""], len(groups[r[1] or ""])) for r in rows), key=str)


def test_groups_of_equal_texts(spark):
    got = deduplicate(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == by_hand(ROWS)
    assert {r.digest for r in got if r.doc_id == 3} == {hashlib.sha256(b"").hexdigest()}
    assert sum(r.kept for r in got) == len({r[1] or "" for r in ROWS})


def test_colliding_digests_are_told_apart_by_full_texts(spark):
    got = deduplicate(spark.createDataFrame(ROWS, SCHEMA), digest=lambda t: F.lit("same")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == by_hand(ROWS)


def test_many_small_batches_give_the_same(spark):
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(60)], "doc_id long, text string").repartition(6)
    got = deduplicate(docs, files_per_batch=1).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == by_hand([(i, f"t{i % 7}") for i in range(60)])


def test_state_goes_on_where_it_stopped(spark, tmp_path):
    schema = "digest string, id long, locator struct<call: int, row: long>"

    def arrive(rows):
        spark.createDataFrame([(d, i, (0, k)) for d, i, k in rows], schema).write.mode("append").parquet(f"{tmp_path}/in")
        return {r.digest: (r.keep.id, r.group_size) for r in keep_in_state(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/run").collect()}

    assert arrive([("a", 1, 0), ("b", 5, 1)]) == {"a": (1, 1), "b": (5, 1)}
    assert arrive([("a", 3, 2), ("b", 2, 3), ("c", 9, 4)]) == {"a": (3, 2), "b": (5, 2), "c": (9, 1)}


@pytest.mark.parametrize("digest", [sha256, lambda t: F.lit("same")])
def test_a_later_call_meets_the_rows_of_those_before(spark, tmp_path, digest):
    for new, so_far in ((ROWS[:6], ROWS[:6]), (ROWS[6:], ROWS)):
        got = deduplicate(spark.createDataFrame(new, SCHEMA), digest, folder=f"{tmp_path}/state").collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == by_hand(new, so_far)


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a", 5, "d", "c"), (2, "a", 6, "e", "c")], "doc_id long, text string, _row long, _DIGEST string, _call string")
    assert [tuple(r) for r in kept_rows(docs).collect()] == [(2, "a", 6, "e", "c")]


def test_empty_table_and_kept_columns(spark):
    assert deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = kept_rows(spark.createDataFrame(ROWS, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "keep_id"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 6, 7, 8]
