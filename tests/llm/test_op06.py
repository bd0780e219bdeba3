import random
import re

import pytest

from larkspar.llm import op06_jaccard
from larkspar.operators.components import components
from larkspar.llm.op06_jaccard import jaccard_components, one_of_each

SCHEMA = "doc_id long, text string"


def by_hand(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    label, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)), n) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links, strict=True))), key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = lambda k: [f"W{r.randint(0, 400)}" for _ in range(k)]
    bases = [words(r.randint(1, 150)) for _ in range(8)]
    common = words(12)
    texts = [None, "", " ", "One", "one two", "ONE  two", "é É"]
    for _ in range(n):
        w = list(r.choice(bases)) if r.random() < 0.8 else words(r.randint(1, 60))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"W{r.randint(0, 400)}"
        texts.append(" ".join(w + (common if r.random() < 0.4 else [])))
    return [(None if i == 9 else i, t) for i, t in enumerate(texts)] + [(12, texts[12])]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_matches_comparing_all_pairs(spark, k, percent):
    rows = corpus(k)
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), k, percent)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str) == by_hand(rows, k, percent)


def test_blocks_of_hot_shingles_and_clusters(spark, monkeypatch):
    for name, value in (("FREQUENT", 5), ("BUCKET_BLOCK", 7), ("PAIRS_AT_ONCE", 10), ("CLUSTER_BLOCK", 60), ("CLUSTER_ROWS", 9), ("COLUMNS", 16), ("DENSE", 3)):
        monkeypatch.setattr(op06_jaccard, name, value)
    rows = corpus(9)
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 90)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str) == by_hand(rows, 3, 90)


def test_empty_table_and_one_of_each(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(3, "a b c d", "x", 0), (1, "A b c d", "y", 0), (2, None, "z", 0), (4, None, "w", 0), (1, "a b c d", "v", 0)]
    got = one_of_each(spark.createDataFrame(rows, SCHEMA + ", component string, _ROW int"), 3, 90)
    assert got.columns == ["doc_id", "text", "component", "_ROW"]
    assert sorted((r.doc_id, r.component) for r in got.collect())[1:] == [(2, "z"), (4, "w")]
    assert got.count() == 3


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_a_long_path(spark, monkeypatch, few):
    monkeypatch.setattr("larkspar.operators.components.FEW_EDGES", few)
    r = random.Random(1)
    names = r.sample(range(1000), 60)
    edges = [(a, b) for a, b in zip(names[:40], names[1:40], strict=False)] + [(names[50], names[51]), (5000, 5000)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: min(names[:40]) for n in names[:40]} | {n: min(names[50:52]) for n in names[50:52]}


def test_words_that_polynomials_take_for_equal(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, " ".join(word)), (4, " ".join(other)), (5, " ".join(word) + " x"), (6, word + " " + other), (7, other + " " + word)]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 90)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str) == by_hand(rows, 3, 90)


def test_a_long_text_and_its_near_copy(spark):
    r = random.Random(8)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(300_000)]
    near = [*words[:100], "other", *words[101:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words))), (4, "short")]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 90)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str) == by_hand(rows, 3, 90)


@pytest.mark.parametrize("block", [op06_jaccard.BUCKET_BLOCK, 7])
def test_long_texts_with_a_passage_in_common_are_told_apart(spark, monkeypatch, block):
    monkeypatch.setattr(op06_jaccard, "BUCKET_BLOCK", block)
    r, met = random.Random(5), []
    common = [f"c{i}" for i in range(60)]
    texts = [common + [f"w{r.randint(0, 10**6)}" for _ in range(11_000)] for _ in range(18)]
    texts.append([*texts[3][:5_000], "other", *texts[3][5_001:]])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    products = op06_jaccard.linked
    monkeypatch.setattr(op06_jaccard, "linked", lambda deltas, percent: met.append(deltas.count()) or products(deltas, percent))
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), 5, 80)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str) == by_hand(rows, 5, 80)
    assert met == [2]  # bitmaps of 4,096 bits are as near to each other as those of similar sets of 11,000 shingles


def test_null_ids_with_names_that_clash(spark):
    rows = [(None, "a b c d e", 1, "x", 2), (None, "a b c d e", 1, "y", 2), (7, "a b c d e", 1, "z", 2), (None, "q r s", 1, "w", 2)]
    got = one_of_each(spark.createDataFrame(rows, SCHEMA + ", component long, `row` string, _row int"), 3, 90)
    assert got.columns == ["doc_id", "text", "component", "row", "_row"]
    assert sorted((r.doc_id or 0, r.row) for r in got.collect()) == [(0, "w"), (7, "z")]
    found = jaccard_components(spark.createDataFrame(rows, SCHEMA + ", component_id long, `row` string, size int"), 3, 90)
    assert sorted(((r.doc_id or 0, r.component_id or 0, r.n_links) for r in found.collect())) == [(0, 0, 0), (0, 7, 2), (0, 7, 2), (7, 7, 2)]
