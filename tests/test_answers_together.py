"""Answers leave a task in frames of many requests, in order, with empty and failed ones."""

import pandas as pd

from larkspar.streaming import connectors


class Inline:
    """Items of one task, answered in this process."""

    def __init__(self, schema, batches):
        self.schema, self.batches = schema, batches

    def mapInPandas(self, run, schema):
        return list(run(iter(self.batches)))


def test_one_frame_holds_the_answers_of_many_requests(spark, monkeypatch):
    real, made = pd.DataFrame, []
    schema = spark.createDataFrame([], "key long, text string").schema
    batches = [real({"key": range(a, a + n), "text": [str(x) for x in range(a, a + n)]}) for a, n in ((0, 150), (150, 0), (150, 51))]

    def connect():
        def ask(items):
            if (items["key"] % 50 == 7).any():
                raise connectors.Refused("no")
            return [(f"{i}:{x}",) for i, x in items["text"].items()]

        return ask

    monkeypatch.setattr(connectors.pd, "DataFrame", lambda *a, **b: made.append(1) or real(*a, **b))
    frames = connectors.answered(Inline(schema, batches), "key", connect, "answer string", connectors.Policy(size=1, concurrent=3))
    monkeypatch.undo()
    found = pd.concat(frames)
    assert list(found["key"]) == list(range(201))
    assert [a for a in found["answer"]] == [None if k % 50 == 7 else f"0:{k}" for k in range(201)]
    assert list(found["error"].notna()) == [k % 50 == 7 for k in range(201)]
    assert len(made) <= 201 // connectors.TOGETHER + 1
