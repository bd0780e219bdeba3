import hashlib
import random

import sentencepiece

from larkspar.llm import op07_sentencepiece as op

sp = sentencepiece.SentencePieceProcessor(model_file=op.public_model())


def texts():
    r = random.Random(7)
    odd = "ab ▁\n\té日é😀xyzthe0 \x00​  "
    out = [None, "", " ", "   ", "\n", "a" * 3_000, " " * 900, " " * 37 + "the", "▁" * 5 + "x", "﻿a", "<s> </s>", "the cat  sat \n on"]
    out += ["".join(r.choice(odd) for _ in range(r.randint(1, 60))) for _ in range(1_500)]
    out += ["".join(r.choice("etaoinshrdlu ") for _ in range(r.randint(1, 900))) for _ in range(300)]
    return out + ["".join(chr(r.choice([r.randint(1, 0x2FFF), r.randint(0x4E00, 0x9FFF), r.randint(0x1F300, 0x1F6FF)])) for _ in range(30)) for _ in range(300)]


def test_equals_the_library(spark):
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts())]
    for r in op.encode(spark.createDataFrame(rows, "doc_id long, text string, n_words string"), op.public_model(), ids=True).collect():
        ids = sp.encode(rows[r.doc_id or 0][1] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.n_words == "x"
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_long_words_go_through_the_rounds():
    r = random.Random(3)
    long = ["a" * 30_001, "".join(r.choice("etaoinshr") for _ in range(4_000)), "".join(r.choice(["the", "ing", "straw", "0"]) for _ in range(2_500)), "é😀" * 500]
    m = op.Merger(op.public_model())
    assert [a for a, _ in m.encode(long)] == [",".join(map(str, sp.encode(t))) for t in long]


def test_names_that_clash(spark):
    docs = spark.createDataFrame([("the cat", 5, 7, "x")], "text string, n_tokens long, IDS long, row string")
    got = op.encode(docs, op.public_model(), ids=True)
    assert got.columns == ["row", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and got.first().ids == sp.encode("the cat")


def test_empty_table(spark):
    assert op.encode(spark.createDataFrame([], "doc_id long, text string"), op.public_model()).count() == 0


def test_repeated_rows_and_ids(spark):
    rows = [(1, "the cat"), (1, "the cat"), (1, "a dog"), (None, "the cat"), (None, None), (None, None)]
    got = op.encode(spark.createDataFrame(rows, "doc_id long, text string"), op.public_model(), ids=True).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((d or 0, sp.encode(t or "")) for d, t in rows)
