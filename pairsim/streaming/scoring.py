"""Clean, score and post-process pairs as they arrive.

Only stateless steps of the prediction path, so no watermark is needed. The
checkpoint belongs in storage all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsim.functions.postprocess import finish_prediction
from pairsim.operators.pairs import clean_pairs
from pairsim.schema import UNLABELLED
from pairsim.sources.pairs import READ_OPTIONS, has_text


def stream_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.options(**READ_OPTIONS).schema(UNLABELLED).csv(folder).where(has_text())


def stream_targets(pairs: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(id, target)`` where ``score`` adds ``prediction``."""
    scored = score(clean_pairs(pairs))
    return scored.select("id", finish_prediction(F.col("prediction")).alias("target"))


def write_targets(targets: DataFrame, folder: str, checkpoint: str):
    """Append all available input to ``folder`` and return the started query."""
    return (
        targets.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
