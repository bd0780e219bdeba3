import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_op10 import SYLLABLES, text

from larkspar.llm.op10_language import SAMPLE_LONGEST, Languages, identify, sample


def test_languages_of_long_documents_are_learned(spark):
    r = random.Random(9)
    rows = [(i, text(k, r, 4000) if k != "bb" else "1 2. " * 3000 + text(k, r, 300), k) for i, k in enumerate(list(SYLLABLES) * 4)]
    assert min(len(x[1]) for x in rows) > SAMPLE_LONGEST
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = sample(docs, F.lit(True))
    assert sorted(found) == sorted(SYLLABLES)
    short = spark.createDataFrame([(i, text(k, r, 30), k) for i, k in enumerate(SYLLABLES)], docs.schema)
    assert all(x.lang_pred == x.lang for x in identify(short, Languages.learn(found)).collect())


def test_the_pipeline_keeps_texts_where_no_language_is_known(spark):
    docs = spark.createDataFrame([(0, "a text", None), (1, "...", None), (2, None, None), (3, "é" * 9000, None)], "doc_id long, text string, lang string")
    assert sorted(x.doc_id for x in corpus_pipeline.language(spark, docs, "").collect()) == [0, 3]
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 3, "xx"))
    assert sorted(x.doc_id for x in corpus_pipeline.language(spark, docs, "").collect()) == [0, 3]
