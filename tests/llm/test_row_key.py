from pyspark.sql import functions as F

from larkspar.llm.common import with_row_key


def test_keys_are_written_with_their_rows(spark):
    # Rows that come in another order each time: what is joined by the key must still be the same row.
    docs = spark.range(2_000).repartition(7).withColumn("at", F.rand())
    keyed = with_row_key(docs, "key")
    again = keyed.select("key", F.col("id").alias("other"), F.col("at").alias("then"))
    both = keyed.join(again, "key")
    assert both.count() == 2_000 and both.filter("id <> other OR at <> then").isEmpty()
