import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from larkspar.llm import op04_phrases
from larkspar.llm.op04_phrases import remove_phrases

SCHEMA = "doc_id long, text string"


def by_hand(texts, length):
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in rows for i in range(len(w) - length + 1))
    for w in rows:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def corpus(seed, n):
    r = random.Random(seed)
    words = lambda k: " ".join(r.choice(["a", "b", "é", "the", " ", "x\0"]) for _ in range(k))
    shared = [words(r.randint(8, 30)) for _ in range(6)]
    out = [None, "", " \n", words(60), "go " * 40]
    out += [r.choice(" \t\n").join(r.choice(shared) if r.random() < 0.4 else words(r.randint(1, 20)) for _ in range(r.randint(1, 5))) for _ in range(n)]
    return out + out[5:9]


def test_matches_counting_every_window(spark):
    texts = corpus(2, 80)
    docs = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])], SCHEMA)
    got = [tuple(r)[1:] for r in remove_phrases(docs, 12).collect()]
    assert Counter(got) == Counter(by_hand([*texts, texts[3]], 12))


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(op04_phrases, "GROUP_CONTENTS", 3)
    r = random.Random(4)
    passage = " ".join(f"w{r.randint(0, 50)}" for _ in range(20))
    texts = [" ".join([*(f"p{r.randint(0, 9)}" for _ in range(r.randint(1, 9))), passage, *(f"q{r.randint(0, 1)}" for _ in range(9))]) for _ in range(70)]
    got = [tuple(x)[1:] for x in remove_phrases(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 12).collect()]
    assert Counter(got) == Counter(by_hand(texts, 12))


def test_empty_table_and_clashing_columns(spark):
    assert remove_phrases(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a " * 90, "x", 2)], SCHEMA + ", key string, n long")
    assert remove_phrases(docs, keep_text=True).select("key", "n", "n_removed", "kept").first() == ("x", 2, 90, "")


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a " * 90, 5, "s", 6, "k", "r"), (2, None, 5, "s", 6, "k", "r")], SCHEMA + ", _row long, spans string, N_WORDS long, kept string, `row` string")
    got = remove_phrases(docs, keep_text=True)
    assert got.columns == ["doc_id", "_row", "spans", "row", "n_words", "n_removed", "kept_sha256", "kept"]
    assert sorted((r.doc_id, r._row, r.spans, r.row, r.n_words, r.n_removed) for r in got.collect()) == [(1, 5, "s", "r", 90, 90), (2, 5, "s", "r", 0, 0)]


def test_shards_of_few_bytes(spark, monkeypatch):
    texts = corpus(5, 60)
    monkeypatch.setattr(op04_phrases, "SHARD_BYTES", 400)
    got = remove_phrases(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 12).collect()
    assert Counter(tuple(r)[1:] for r in got) == Counter(by_hand(texts, 12))


def test_automata_of_few_words_find_every_place(monkeypatch):
    monkeypatch.setattr(op04_phrases, "AUTOMATON", 6)
    r = random.Random(6)
    some = lambda k: [r.choice("abc") for _ in range(k)]
    passages, words = [some(r.randint(2, 4)) for _ in range(7)], some(200)
    automata = op04_phrases.Automata(2)
    automata.begin(0)
    for p in passages:
        automata.add(" ".join(p))
    assert len(automata.made) >= 3
    want = {(i, i + len(p)) for p in passages for i in range(len(words)) if words[i : i + len(p)] == p}
    assert set(automata.located(200, lambda i, j: words[i:j])) == want and not list(automata.located(2, lambda i, j: ["x", "y"]))
    monkeypatch.setattr(op04_phrases, "STREAMED", 7)
    automata.piece = 4
    assert set(automata.located(200, lambda i, j: words[i:j])) == want and not list(automata.located(0, lambda i, j: []))


def thue_morse(n):
    """2 ** n letters and their complement: equal under every polynomial hash modulo 2 ** 64 with an odd base."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_take_for_equal(spark):
    one, other = thue_morse(11)
    texts = [" ".join([*(f"w{i}" for i in range(34)), x]) for x in (one, other)]
    texts += [" ".join(w) for w in thue_morse(12)]  # the same with letters as words
    texts += [" ".join(["u", *"".join(w)]) for w in (one, other)]
    got = [tuple(r)[1:] for r in remove_phrases(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 35).collect()]
    assert Counter(got) == Counter(by_hand(texts, 35))
    assert sorted(g[1] for g in got if g[0] == 35) == [0, 0]


def test_windows_are_compared_word_by_word():
    texts = ["a b c a b c a b", "b c a b x", "c"]
    owner, name = op04_phrases.window_names(pa.array(texts), np.array([6, 3, 0]), 3)
    words = [t.split() for t in texts]
    windows = [tuple(words[o][i : i + 3]) for o, n in enumerate((6, 3, 0)) for i in range(n)]
    assert owner.tolist() == [0] * 6 + [1] * 3
    assert [[a == b for a in name] for b in name] == [[a == b for a in windows] for b in windows]


def test_a_passage_of_more_different_words_than_an_automaton_has_characters(spark):
    passage = " ".join(map(str, range(1_200_000)))
    texts = [passage, "x " + passage + " y", "1 2 3"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_phrases(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 35, keep_text=True).collect()}
    assert got == {0: (1_200_000, 1_200_000, ""), 1: (1_200_002, 1_200_000, "x y"), 2: (3, 0, "1 2 3")}


def test_passages_in_pieces(spark, monkeypatch):
    for name, value in (("PIECE", 25), ("AUTOMATON", 60), ("STREAMED", 9)):
        monkeypatch.setattr(op04_phrases, name, value)
    texts = corpus(7, 60)
    got = [tuple(r)[1:] for r in remove_phrases(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 12).collect()]
    assert Counter(got) == Counter(by_hand(texts, 12))


def test_windows_of_hot_anchors_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(op04_phrases, "GROUP_CONTENTS", 2)
    plans = []

    class Recorded(op04_phrases.Scratch):
        def stored(self, df, name):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().stored(df, name)

    monkeypatch.setattr(op04_phrases, "Scratch", Recorded)
    texts = corpus(7, 60)
    got = [tuple(r)[1:] for r in remove_phrases(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 12).collect()]
    assert Counter(got) == Counter(by_hand(texts, 12))
    assert sum(p.count("MapInArrow all_windows") for p in plans) == 1
