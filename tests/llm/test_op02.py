import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larkspar.llm import anchors, op02_suffix_array
from larkspar.llm.anchors import Grain, segments
from larkspar.llm.op02_suffix_array import long_common_prefixes, remove_repeats

SCHEMA = "doc_id long, text string"


def by_hand(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def corpus(seed, n, alphabet, longest):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    shared = [word(r.randint(20, 90)) for _ in range(6)]
    out = [None, "", "x", word(400), "ab" * 150]
    out += ["".join(r.choice(shared) if r.random() < 0.3 else word(r.randint(1, longest)) for _ in range(r.randint(1, 6))) for _ in range(n)]
    return out + out[5:9] + [out[6] + "!"]


@pytest.mark.parametrize("length", [12, 40])
def test_matches_counting_every_string(spark, length):
    texts = corpus(length, 60, "abcdé\0 ", 60)
    docs = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])], SCHEMA)
    texts.append(texts[3])
    got = [tuple(r)[1:] for r in remove_repeats(docs, length).collect()]
    assert Counter(got) == Counter(by_hand([(t or "").encode() for t in texts], length))


def test_crowded_anchors_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(op02_suffix_array, "GROUP_BYTES", 400)
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh") for _ in range(70))
    tails = ["".join(r.choice("xyz") for _ in range(30)) for _ in range(3)]
    texts = ["".join(r.choice("xyz") for _ in range(r.randint(3, 30))) + passage + r.choice(tails)[: r.randint(5, 30)] + "".join(r.choice("xyz") for _ in range(30)) for _ in range(80)]
    got = [tuple(x)[1:] for x in remove_repeats(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 40).collect()]
    assert Counter(got) == Counter(by_hand([t.encode() for t in texts], 40))


def test_empty_table_and_clashing_columns(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a" * 900, "x", 2)], SCHEMA + ", key string, n long")
    assert remove_repeats(docs).select("key", "n", "n_removed").first() == ("x", 2, 900)


def test_expansion_against_sorting():
    r = np.random.default_rng(3)
    for length in (3, 9, 30):
        codes = r.integers(1, 4, 600).astype(np.uint16)
        codes[200:260] = codes[100:160]
        codes[-1] = 0
        order, shared = long_common_prefixes(codes, length)
        text = codes.astype("u2").tobytes()
        cut = [text[2 * i : 2 * i + 2 * length] for i in order]
        assert cut == sorted(cut, key=lambda b: list(np.frombuffer(b, "u2"))) or length > 567
        whole = [cut[i] == cut[i - 1] and len(cut[i]) == 2 * length for i in range(1, len(cut))]
        assert whole == shared[1:].tolist()


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "ab" * 60, 5, "s", 6, "k"), (2, None, 5, "s", 6, "k")], SCHEMA + ", _row long, spans string, N_BYTES long, kept string")
    got = remove_repeats(docs, 20, keep_text=True)
    assert got.columns == ["doc_id", "_row", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    assert sorted((r.doc_id, r._row, r.spans, r.n_bytes, r.n_removed) for r in got.collect()) == [(1, 5, "s", 120, 120), (2, 5, "s", 0, 0)]


def test_long_texts_and_strips(spark, monkeypatch):
    r = random.Random(11)
    base = "".join(r.choice("abcdefgh") for _ in range(500_000))
    texts = [base, base[1_000:200_000] + "".join(r.choice("ijkl") for _ in range(200_000)), "ab" * 150_000, "x" * 399, base[499_700:] + "z" * 500]
    got = {x[0]: tuple(x)[1:] for x in remove_repeats(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert [g[1] for _, g in sorted(got.items())] == [199_000, 199_000, 300_000, 0, 500]
    assert got[0][3] == hashlib.sha256((base[:1_000] + base[200_000:]).encode()).hexdigest()


def test_segments_do_not_depend_on_strips(monkeypatch):
    symbols = np.random.default_rng(2).integers(0, 3, 5_000).astype(np.uint8)
    at = np.array([0, 0, 7, 1_500, 1_500, 1_530, 4_000, 5_000])
    for by_key in (False, True):
        whole = segments(symbols, at, Grain(20, 4), by_key)
        assert all(first + 20 + at[row] <= at[row + 1] for row, first in zip(whole.row, whole.last, strict=True))
        with monkeypatch.context() as m:
            m.setattr(anchors, "WINDOWS", 64)
            assert all(np.array_equal(a, b) for a, b in zip(vars(whole).values(), vars(segments(symbols, at, Grain(20, 4), by_key)).values(), strict=True))
        assert (whole.last - whole.first + 1).sum() == sum(max(0, n - 19) for n in np.diff(at))
