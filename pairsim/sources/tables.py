"""Dictionary and metric-log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairsim.operators.synonyms import flatten_synonyms
from pairsim.schema import METRICS


def load_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """Synonym dictionary from parquet or JSON lines; nested lists are flattened."""
    reader = spark.read.json if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet
    return flatten_synonyms(reader(path))


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.select(*METRICS.names).write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(path)
