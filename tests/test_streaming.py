"""Connectors with injected failures, and event time against batch results on late and repeated rows."""

import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspar.streaming import event_time
from larkspar.streaming.connectors import Policy, Refused, answer_stream, answered, retry

FAST = {"wait": 0.001}


def stub(folder, broken="", slow=False):
    """A service that counts its calls in files, fails as often as an item says, and refuses some."""

    def connect():
        (folder / "connections").open("a").write("x")

        def ask(items: pd.DataFrame) -> list[tuple]:
            with (folder / f"calls-{items['key'].iloc[0]}").open("a") as f:
                f.write("x")
            calls = (folder / f"calls-{items['key'].iloc[0]}").stat().st_size
            if slow:
                time.sleep(0.01 * (5 - items["key"].iloc[0] % 5))
            if (items["text"] == "refused").any():
                raise Refused("never")
            if broken and items["text"].isin([broken]).any() and not (folder / "mended").exists():
                raise OSError("down")
            if calls <= items["fails"].max():
                raise OSError("busy")
            return [(f"<{t}>", len(t)) for t in items["text"]]

        return ask

    return connect


SCHEMA, ANSWER = "key long, text string, fails int", "answer string, size int"


def test_answers_keep_their_order_and_failures_back_off(spark, tmp_path):
    rows = [(i, f"t{i}", i % 4) for i in range(40)] + [(40, "refused", 0)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = answered(df, "key", stub(tmp_path, slow=True), ANSWER, Policy(size=1, concurrent=4, attempts=3, **FAST)).collect()
    assert [r.key for r in got] == list(range(41))
    for r in got[:40]:
        ok = r.key % 4 < 3
        assert (r.answer, r.attempts, r.error) == ((f"<t{r.key}>", r.key % 4 + 1, None) if ok else (None, 3, "OSError: busy"))
    assert (got[40].attempts, got[40].error) == (1, "Refused: never")
    assert (tmp_path / "connections").stat().st_size == 1


def test_requests_of_many_items_fail_together_or_get_the_default(spark, tmp_path):
    rows = [(i, "bad" if i == 5 else f"t{i}", 0) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = {r.key: r.error for r in answered(df, "key", stub(tmp_path, "bad"), ANSWER, Policy(size=4, attempts=2, **FAST)).collect()}
    assert {k for k, e in got.items() if e} == {4, 5, 6, 7}
    one = {r.key: (r.answer, r.size, r.error) for r in answered(df, "key", stub(tmp_path, "bad"), ANSWER, Policy(size=1, attempts=2, on_failure="default", default=("unknown", 0), **FAST)).collect()}
    assert one[5] == ("unknown", 0, "OSError: down") and one[4] == ("<t4>", 2, None)
    with pytest.raises(Exception, match="down"):
        answered(df, "key", stub(tmp_path, "bad"), ANSWER, Policy(attempts=2, on_failure="stop", **FAST)).collect()
    with pytest.raises(ValueError, match="default"):
        Policy(on_failure="default")
    short = lambda: lambda items: [("x", 1)]
    assert {r.error for r in answered(df, "key", short, ANSWER, Policy(size=2, attempts=1)).collect()} == {"ValueError: 1 answers to 2 items"}
    assert answered(df.limit(0), "key", short, ANSWER).count() == 0


def test_a_stream_loses_and_doubles_nothing(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/run"
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    policy = Policy(size=1, attempts=2, **FAST)
    put([(i, "bad" if i % 5 == 0 else f"t{i}", 0) for i in range(20)] + [(3, "t3", 0)])
    answers, failures = answer_stream(spark, source, folder, "key", stub(tmp_path, "bad"), ANSWER, policy)
    assert sorted(r.key for r in answers.collect()) == [i for i in range(20) if i % 5] and sorted(r.key for r in failures.collect()) == [0, 5, 10, 15]
    # The next run stops at its first failure: its batch is not checkpointed, and is done again by the one after it.
    put([(i, "bad" if i == 25 else f"t{i}", 0) for i in range(15, 30) if i != 20])
    with pytest.raises(Exception, match="down"):
        answer_stream(spark, source, folder, "key", stub(tmp_path, "bad"), ANSWER, Policy(size=1, attempts=1, on_failure="stop"))
    answers, failures = answer_stream(spark, source, folder, "key", stub(tmp_path, "bad"), ANSWER, policy)
    assert sorted(r.key for r in answers.collect()) == [i for i in range(30) if i % 5] and sorted(r.key for r in failures.collect()) == [0, 5, 10, 15, 25]
    (tmp_path / "mended").touch()
    answers, failures = retry(spark, source, folder, "key", stub(tmp_path, "bad"), ANSWER, policy)
    assert sorted(r.key for r in answers.collect()) == [i for i in range(30) if i != 20] and failures.count() == 0
    assert (tmp_path / "calls-1").stat().st_size == 1  # asked for once in all runs
    answers, _ = answer_stream(spark, source, folder, "key", stub(tmp_path, "bad"), ANSWER, policy)
    assert answers.count() == 29


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_sessions_of_late_and_repeated_events_equal_those_of_a_table(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, value double"
    event = lambda i, m, u: (i, at(m), u, 1.0)
    batches = [
        [event(1, 0, 1), event(2, 8, 1), event(3, 3, 2)],
        [event(2, 8, 1), event(4, 5, 2), event(5, 30, 1)],  # a repetition, and one that is late but within bounds
        [event(6, 21, 1), event(5, 30, 1), event(7, 60, 2)],
        [event(8, 9, 1), event(9, 200, 3), event(9, 200, 3)],  # 8 comes behind the watermark
        [event(10, 300, 3)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
        got = event_time.closed_sessions(spark, f"{tmp_path}/in", f"{tmp_path}/run", "event_id", "user_id", "10 minutes", "20 minutes", files_per_batch=1)
    table = spark.read.parquet(f"{tmp_path}/in").filter("event_id <> 8")
    whole = event_time.sessions(event_time.once(table, "event_id", "20 minutes"), "user_id", "10 minutes", "20 minutes")
    closed = whole.filter(F.col("session_end") <= F.lit(at(300 - 20)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))
    assert closed.count() >= 4 and whole.count() == closed.count() + 1


def test_windows_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rows = [(i, at(7 * i % 100), i % 3, float(i)) for i in range(60)] + [(99, None, 1, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    table = {tuple(r) for r in event_time.window_counts(df, "user_id", "15 minutes", "0 seconds").collect()}
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = event_time.window_counts(stream, "user_id", "15 minutes", "1 day").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("windows").filter("window_start IS NOT NULL").collect()} == table
