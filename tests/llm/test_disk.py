"""What the pipeline and near duplicates keep on disk."""

from pathlib import Path

import corpus_pipeline
from larkspar.llm import op01_exact_dedup, op06_jaccard
from larkspar.storage import Scratch


def shared(spark):
    return Path(spark.conf.get("spark.checkpoint.dir")) / "larkspar"


def files(spark):
    return {str(p.relative_to(shared(spark))) for p in shared(spark).rglob("*") if p.is_file() and p.name[0] not in "._"}


def documents(spark, n):
    text = "concat_ws(' ', transform(sequence(1, 30), i -> translate(hex(xxhash64(id, i)), '0123456789', 'ghijklmnop')))"
    return spark.range(n).selectExpr("id AS doc_id", f"{text} AS text", "'aa' AS lang", "'s' AS source", "30L AS n_chars")


def test_the_pipeline_leaves_its_result_only(spark, tmp_path):
    documents(spark, 60).write.parquet(f"{tmp_path}/documents.parquet")
    before = files(spark)
    found = corpus_pipeline.run(spark, str(tmp_path))
    left = files(spark) - before
    assert found.count() == 60
    assert left and {p.split("/")[1] for p in left} == {"sentencepiece"}


def test_exact_copies_leave_no_log_and_no_state(spark):
    docs = documents(spark, 50).unionByName(documents(spark, 20))
    before = files(spark)
    assert op01_exact_dedup.kept_rows(docs).count() == 50
    assert not {p for p in files(spark) - before if "/dedup/" in p and "/dedup/content/" not in p}


def test_shingles_that_stand_once_are_not_stored(spark, monkeypatch):
    whole, rows = Scratch.stored, {}

    def counted(self, df, name):
        out = whole(self, df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(Scratch, "stored", counted)
    found = op06_jaccard.jaccard_components(documents(spark, 40).unionByName(documents(spark, 10).selectExpr("doc_id + 100 AS doc_id", "concat(text, ' end') AS text", "lang", "source", "n_chars")), 3, 90)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i % 100 for i in [*range(40), *range(100, 110)]}
    # 40 texts have 4 first shingles each at least; only those of the 20 that are near another stand twice.
    assert max(rows.values()) <= 20 * 4
