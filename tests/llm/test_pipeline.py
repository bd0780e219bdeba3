import random
from collections import Counter

import sentencepiece

import corpus_pipeline
from larkspar.llm import op07_sentencepiece


def test_stages_against_a_plain_version(spark, tmp_path):
    r = random.Random(2)
    words = lambda n: " ".join("".join(r.choice(["ka", "no", "mi", "ru"]) for _ in range(r.randint(1, 4))) for _ in range(n))
    base = [words(60) for _ in range(40)]
    near = " ".join([*base[0].split()[:-1], "changed"])
    texts = [*base, base[3], near, None, "", "123 !!", base[3]]
    rows = [(i, t, "aa", "s0" if i % 3 else "s1", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 3, 40 and 45 are equal: the largest id stays; 0 and 41 are near: the smallest stays; 42 to 44 have no letter.
    stay = (set(range(40)) - {3}) | {45}
    counts = Counter(x.doc_id for x in got)
    assert set(counts) == stay and max(counts.values()) <= 2
    tokens = {s: sum(len(texts[i].split()) for i in stay if rows[i][3] == s) for s in ("s0", "s1")}
    largest = max(tokens, key=tokens.get)
    assert all(counts[i] == 1 for i in stay if rows[i][3] == largest)
    sp = sentencepiece.SentencePieceProcessor(model_file=op07_sentencepiece.public_model())
    assert all(x.n_tokens == len(sp.encode(texts[x.doc_id])) for x in got)


def test_every_stage_returns_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet" if not i else f"{tmp_path}/{i - 1}"), str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        assert spark.read.parquet(f"{tmp_path}/{i}").columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_and_columns_that_clash(spark, tmp_path):
    text = lambda i: " ".join(f"{w}{'abcdefghij'[i]}" for w in "ka no mi ru ta so le".split() * 4)
    rows = [(i % 3, text(i), "aa", "s", 9, "l", 5, 1.5) for i in range(6)] + [(None, text(7), "aa", None, 9, "l", 5, 1.5), (4, text(0), "aa", "s", 9, "l", 5, 1.5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, copies int, score double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of the equal texts of 0 and 4 the larger id stays; all else differs.
    assert sorted({(-1 if r.doc_id is None else r.doc_id) for r in got}) == [-1, 0, 1, 2, 4]
    assert Counter(r.doc_id for r in got)[0] >= 1 and len({(r.doc_id, r.ids_sha256) for r in got}) == 7
    assert {(r.lang_pred, r.copies, r.score) for r in got} == {("l", 5, 1.5)}
