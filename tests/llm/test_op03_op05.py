import random

import numpy as np
import pytest
import zstandard

from larkspar.llm.common import labelled_sample
from larkspar.llm.op03_toxicity import LEVEL, WINDOW, Classifier, windows
from larkspar.llm.op05_quality import CHUNK, OVERLAP, STRIDE, WIDTH, Network, chunk_starts, scored

from pyspark.sql import functions as F


def texts(seed, n, marks):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "the", "ou", "er", "ti", "on"]) for _ in range(r.randint(1, 4)))
    out = []
    for i in range(n):
        y = i % 2
        words = [word() for _ in range(r.randint(20, 200))]
        if y:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(marks)
        out.append((" ".join(words), y))
    return out


def blocks_of(rows):
    raw = [t.encode() for t, _ in rows]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]


@pytest.mark.parametrize(("fit", "marks"), [(Network.fit, ["###", "$$$ !!", "%%%"]), (Classifier.fit, ["wretched", "mudbrain", "vilely"])])
def test_held_out_accuracy(fit, marks):
    model = fit(texts(1, 400, marks))
    rest = texts(2, 200, marks)
    p = model.score(*blocks_of(rest))
    assert ((p >= 0.5) == np.array([y for _, y in rest])).mean() > 0.93
    assert ((p >= 0) & (p <= 1)).all()


def test_chunks_cover_every_byte_and_the_end_of_long_texts_counts():
    for n in (0, 1, WIDTH, 511, 512, 513, 5_000):
        row, start, length = chunk_starts(np.array([0, n]))
        covered = np.zeros(n, bool)
        for s, k in zip(start, length, strict=True):
            covered[s : s + k] = True
        assert covered.all() and (length <= CHUNK).all() and CHUNK % STRIDE == 0
    model = Network.fit(texts(1, 200, ["###", "%%%"]))
    plain = "the an " * 60_000
    a, b = (model.features(*blocks_of([(t, 0)])) for t in (plain, plain + "### %%% ### %%% ###"))
    assert not np.array_equal(a, b)


def test_gradients_against_differences():
    net = Network.fresh(3)
    rows = texts(4, 4, ["###"])
    raw, at = blocks_of(rows)
    y, share = np.array([y for _, y in rows], np.float32), np.ones(4, np.float32)
    grads = net.gradients(raw, at, y, share)

    def loss():
        p = net.score(raw, at)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for value, g in zip((net.weights, net.offset), grads[2:], strict=True):
        for i in range(len(value)):
            before = value[i]
            value[i] = before + 1e-2
            up = loss()
            value[i] = before - 1e-2
            down = loss()
            value[i] = before
            assert abs((up - down) / 2e-2 - g[i]) < 5e-3


def plain_score(net, raw):
    """The network by its definition, one chunk, place and byte after the other."""
    tops = []
    starts = range(0, max(1, len(raw) - OVERLAP), CHUNK - OVERLAP)
    for chunk in (raw[s : s + CHUNK] for s in starts):
        best = np.full(len(net.bias), -np.inf)
        for at in range(0, max(1, len(chunk) - WIDTH + STRIDE), STRIDE):
            window = chunk[at : at + WIDTH].ljust(WIDTH, b"\0")
            best = np.maximum(best, net.bias + sum(net.filters[k][b] for k, b in enumerate(window)))
        tops.append(np.maximum(best, 0))
    x = np.concatenate([np.max(tops, 0), np.mean(tops, 0)]).astype(np.float64)
    return 1 / (1 + np.exp(-(x @ net.weights.astype(np.float64) + float(net.offset[0]))))


def test_forward_pass_against_its_definition(monkeypatch):
    net = Network.fit(texts(6, 40, ["###"]))
    rows = [("", 0), ("a", 0), ("abcdefg", 0), ("é" * 300, 0), *texts(7, 6, ["###"]), ("x### " * 2_000, 1)]
    want = [plain_score(net, t.encode()) for t, _ in rows]
    assert np.allclose(net.score(*blocks_of(rows)), want, atol=1e-5)
    monkeypatch.setattr("larkspar.llm.op05_quality.STRIP", 3 * (CHUNK - OVERLAP) + OVERLAP)
    assert np.allclose([net.score(*blocks_of([r]))[0] for r in rows], want, atol=1e-5)


def test_gains_against_plain_compression():
    model = Classifier.fit(texts(1, 300, ["wretched", "mudbrain"]))
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=1 << 16, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    size = lambda w, d: len(zstandard.ZstdCompressor(compression_params=p, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(w))
    for t, _ in texts(8, 12, ["wretched", "mudbrain"]):
        assert model.gains(t.encode()) == [size(w, model.ordinary) - size(w, model.ordinary + model.toxic) for w in windows(t.encode())]


def test_toxicity_of_odd_rows(spark):
    model = Classifier.fit(texts(1, 300, ["wretched", "mudbrain"]))
    rows = [(1, None, "a"), (None, "", "b"), (3, "wretched mudbrain " * 40, "c"), (3, "wretched mudbrain " * 40, "c"), (4, "the an " * 60_000, None), (5, " \n", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE string")
    got = scored(docs, model.score)
    assert got.columns == ["doc_id", "score"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[1] == by[None] == by[5] and by[3][0] == by[3][1] > 0.5 > by[4][0]
    assert scored(docs.limit(0), model.score).count() == 0


def test_ids_that_repeat_are_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(3_000)] + [(2, "u")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, i % 2) for i in range(100)] + [(2, 1)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 100, 16_000) == [("t0", 0), ("u", 1)]


def test_one_class_and_no_examples():
    for fit in (Network.fit, Classifier.fit):
        assert (fit([("a b", 1), ("c", 1)]).score(*blocks_of([("x", 0), ("", 0)])) > 0.5).all()
        assert len(fit([]).score(np.zeros(0, np.uint8), np.zeros(1, np.int64))) == 0


def test_windows_hold_every_word():
    text = b" ".join(b"w%d" % i for i in range(500))
    assert b"".join(windows(text)).split() == text.split() and windows(b" \n") == []


def test_scores_of_odd_rows(spark):
    net = Network.fit(texts(1, 60, ["###"]))
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.1), (3, "é" * 70_000, None)], "doc_id long, text string, other double")
    got = scored(docs, net.score).collect()
    assert [r.other for r in got] == [0.5, 0.1, None] and got[0].score == got[1].score
    assert scored(docs.filter("doc_id = 99"), net.score).count() == 0


def test_sample_is_bounded_and_keeps_to_its_fold(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i % 5 else None) for i in range(400)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", F.col("doc_id") < 300, 32, 16_000)
    assert 0 < len(got) <= 64 and all(int(t[1:]) < 300 and int(t[1:]) % 2 == y for t, y in got)
