import hashlib
import random
import re

import pytest
import zstandard

from larkspar.llm import op11_middle
from larkspar.llm.op11_middle import fill_in_middle

SCHEMA = "doc_id long, text string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(v % (len(units) + 1) for v in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, digest(text), digest(text), text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), digest(out), digest(text), out


def corpus(seed, n):
    r = random.Random(seed)
    some = lambda: r.choice(["a", "bé", "the", " ", "𝒳y", "x\0", "<", "<P", "S>"])
    out = [None, "", " ", "\n\t ", "one", " one", "one ", "x <P> y", "a<S>", "<M>", "é" * 50]
    return out + ["".join(some() + r.choice([" ", "\n ", "\t", "  "]) * r.randint(0, 1) for _ in range(r.randint(1, 90))) for _ in range(n)]


@pytest.mark.parametrize("size", [7, 1 << 16])
def test_matches_cutting_whole_texts(spark, monkeypatch, size):
    monkeypatch.setattr(op11_middle, "FRAME_BYTES", size)
    rows = list(enumerate(corpus(1, 150))) + [(None, "one two three"), (None, "four five"), (5, " one"), (5, " one")]
    opener = zstandard.ZstdDecompressor()
    for rate in (50, 100):
        got = fill_in_middle(spark.createDataFrame(rows, SCHEMA), rate=rate, keep_output=True).collect()
        out = sorted((tuple(r)[:7] + (b"".join(opener.decompress(f.data) for f in r.output).decode(),) for r in got), key=str)
        assert out == sorted((by_hand(d, t, rate=rate) for d, t in rows), key=str)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_a_long_text_is_cut_in_its_frames(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["wörd", "a", "<", "long" * 9]) for _ in range(200_000))) for i in range(6)] + [(7, "z" * 300_000), (8, " " * 200_000)]
    got = fill_in_middle(spark.createDataFrame(rows, SCHEMA), rate=100).collect()
    assert sorted(tuple(x) for x in got) == sorted(by_hand(d, t, rate=100)[:7] for d, t in rows)


def test_only_the_frames_of_the_cuts_are_opened(monkeypatch):
    monkeypatch.setattr(op11_middle, "FRAME_BYTES", 10)
    opened = []

    class Opener:
        def decompress(self, data):
            opened.append(data)
            return zstandard.ZstdDecompressor().decompress(data)

    text, packer = op11_middle.Frames(), zstandard.ZstdCompressor()
    for i in range(100):
        text.add(b" w%02d x" % i, 2, packer)
    assert text.place(101, Opener()) == (50 * 6 + 4, 50 * 6 + 4) and len(opened) == 1
    opened.clear()
    assert b"".join(text.read(298, 310, Opener())) == (b"".join(b" w%02d x" % i for i in range(100)))[298:310] and len(opened) == 3


def test_empty_table_and_names_that_clash(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5, "f", "k", 7), (2, None, 5, "f", "k", 7)], SCHEMA + ", N long, form string, frames string, `row` long")
    got = fill_in_middle(docs)
    assert got.columns == ["doc_id", "frames", "row", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted((r.doc_id, r.frames, r.row, r.n) for r in got.collect()) == [(1, "k", 7, 2), (2, "k", 7, 0)]
