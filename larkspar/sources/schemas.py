"""Schemas of the tables that runs exchange."""

from pyspark.sql import types as T


def strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# The columns of a label run and of embedding rows.
LABELS = T.StructType(strings("jpg", "xmp", "filename", "category", "label", "label_cn", "confidence", "note", "prior_category", "prior_label", "applied", "run_label", "response_json"))
EMBEDDINGS = T.StructType([*strings("key", "year", "library", "trip", "stem", "jpg_path", "xmp", "species"), T.StructField("confidence", T.DoubleType()), *strings("applied", "model", "image_size"), T.StructField("embedding", T.ArrayType(T.FloatType()))])
