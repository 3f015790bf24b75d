"""Ensembles and submissions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsim.functions.postprocess import finish_prediction
from pairsim.operators.position import with_position
from pairsim.sources.scratch import durable


def ensemble_weighted(predictions: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted mean per id of ``(model, id, prediction)``; unnamed models do not count.

    Weights are literals, so there is no join.
    """
    w = F.lit(None).cast("double")
    for model, weight in weights.items():
        w = F.when(F.col("model") == model, F.lit(float(weight))).otherwise(w)
    named = predictions.where(F.col("model").isin(list(weights))).withColumn("_w", w)
    return named.groupBy("id").agg(
        F.try_divide(F.sum(F.col("_w") * F.col("prediction")), F.sum("_w")).alias("prediction")
    )


def build_submission(template: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(id, target)`` for every template row, rounded and clipped; NULL where no
    prediction exists. Several predictions for one id are an error."""
    several = F.raise_error(F.concat(F.lit("several predictions for id "), F.col("id").cast("string")))
    one = F.when(F.col("n") > 1, several.cast("double")).otherwise(F.col("prediction"))
    p = (
        predictions.groupBy("id")
        .agg(F.count("*").alias("n"), F.first("prediction").alias("prediction"))
        .select("id", finish_prediction(one).alias("target"))
    )
    return template.select("id").join(p, "id", "left")


def attach_by_position(
    template: DataFrame, predictions: DataFrame, template_order: Sequence[str], prediction_order: Sequence[str]
) -> DataFrame:
    """``(id, target)``: the k-th prediction for the k-th template row, rounded and clipped.

    Either table is numbered by its own order, which has to identify its rows (``FILE_ORDER`` for the order of files).
    Tables of different length are refused.
    """
    first = durable(with_position(template, template_order, name="_pos").select("id", "_pos"))
    second = durable(with_position(predictions, prediction_order, name="_pos").select("prediction", "_pos"))
    n, m = first.count(), second.count()
    if n != m:
        raise ValueError(f"{n} rows in the template, {m} predictions")
    return first.join(second, "_pos").select("id", finish_prediction(F.col("prediction")).alias("target"))


def missing_predictions(submission: DataFrame) -> DataFrame:
    return submission.agg(
        F.count("*").alias("template_rows"),
        F.count_if(F.col("target").isNull()).alias("missing"),
    )
