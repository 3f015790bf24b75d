"""Column names and explicit schemas of the pair tables."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT_COLUMNS = ("sentence_1", "sentence_2")
LABEL = "label"
BINARY_LABEL = "binary-label"
VALUE_COLUMNS = ("id", "source", *TEXT_COLUMNS, LABEL, BINARY_LABEL)

# Rows that share an id (a pair and its swapped copy) differ in ``variant``.
ROW_KEY = ("id", "variant")

PAIR = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("sentence_1", T.StringType()),
        T.StructField("sentence_2", T.StringType()),
        T.StructField("label", T.DoubleType()),
        T.StructField("binary-label", T.DoubleType()),
    ]
)

UNLABELLED = T.StructType([f for f in PAIR.fields if f.name not in (LABEL, BINARY_LABEL)])

SUBMISSION = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("target", T.DoubleType())]
)

SYNONYMS = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("synonyms", T.ArrayType(T.StringType())),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

MEMO = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("back_text", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)
