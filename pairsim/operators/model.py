"""Fitting, scoring, evaluating and tuning similarity regressors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsim.functions.seeded import draw_index
from pairsim.operators.metrics import evaluate
from pairsim.operators.moments import LinearFit, fit_robust, moments, read_moments
from pairsim.schema import METRICS


#: Losses that are fitted by reweighted least squares.
ROBUST = ("L1", "Huber")


def regressor(loss: str, weight_decay: float = 0.0, **params):
    """Spark ML estimator for a loss name.

    MSE and plcc share the least-squares fit, which has the largest squared
    correlation among linear scores.
    """
    common = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction"}
    if loss not in ("MSE", "plcc"):
        raise ValueError(f"{loss} has no estimator of Spark ML: use fit_similarity")
    return LinearRegression(regParam=weight_decay, **common, **params)


def similarity_pipeline(
    features: Sequence[str], loss: str = "MSE", weight_decay: float = 0.0, **params
) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, regressor(loss, weight_decay, **params)])


def linear_model(fit: LinearFit) -> PipelineModel:
    """A fit as a pipeline that adds ``prediction``; it saves and loads as any other."""
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {fit.sql()} AS prediction FROM __THIS__")])


def fit_similarity(
    train: DataFrame, features: Sequence[str], loss: str = "L1", weight_decay: float = 0.0, **params
) -> PipelineModel:
    """Fit one of the four losses; L1 and Huber take ``rounds``, the others Spark ML's settings."""
    rows = train.select(*features, F.col("label").cast("double"))
    if loss in ROBUST:
        return linear_model(fit_robust(rows, features, loss, weight_decay, **params)[0])
    return similarity_pipeline(features, loss, weight_decay, **params).fit(rows)


def score_pairs(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction``; never drops a row."""
    return model.transform(df).drop("features")


def score_with(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.Series]],
    columns: Sequence[str] = ("sentence_1", "sentence_2"),
) -> DataFrame:
    """Add ``prediction`` from a user function over Arrow batches.

    ``load`` runs once per task and returns the batch scorer.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        scorer = load()
        for batch in batches:
            yield scorer(batch).astype("float64")

    return df.withColumn("prediction", score(F.struct(*columns)))


def evaluate_model(model: PipelineModel, df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    return evaluate(score_pairs(model, df), by)


def save_model(model: PipelineModel, folder: str, name: str, now: datetime | None = None) -> str:
    """Write a fitted pipeline under a timestamped name and return its path."""
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/{name.replace('/', '_')}_{stamp}"
    model.write().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def tune_similarity(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    grid: dict[str, Sequence],
    loss: str = "MSE",
    trials: int = 10,
    seed: int = 777,
) -> tuple[DataFrame, list[PipelineModel]]:
    """Random search scored on a fixed validation split.

    Every trial draws one combination of ``grid`` (names of regressor settings).
    Returns the metric log ``(run_id, epoch, metric, value)`` and the models.
    """
    spark = train.sparkSession
    pipeline = similarity_pipeline(features, loss)
    stage = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, options in grid.items():
        builder = builder.addGrid(stage.getParam(name), list(options))
    combos = builder.build()
    # Seeded draws with replacement over the grid (a list of settings, not data).
    picks = [
        r.i
        for r in spark.range(trials)
        .select("id", draw_index(F.lit(len(combos)), seed, "trial", F.col("id")).alias("i"))
        .orderBy("id")
        .collect()
    ]
    fitted = dict(pipeline.fitMultiple(train, [combos[i] for i in picks]))
    models = [fitted[t] for t in range(trials)]
    logs = [
        evaluate(score_pairs(m, validation), by=())
        .select(
            F.lit(f"trial-{t:03d}").alias("run_id"),
            F.lit(0).cast("long").alias("epoch"),
            F.inline(
                F.array(
                    F.struct(F.lit("val_loss").alias("metric"), F.col(f"loss_{loss.lower()}").alias("value")),
                    F.struct(F.lit("val_pearson").alias("metric"), F.col("pearson").alias("value")),
                )
            ),
        )
        for t, m in enumerate(models)
    ]
    log = logs[0]
    for other in logs[1:]:
        log = log.unionByName(other)
    return log.select(*METRICS.names), models


def tune_ridge(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    decays: Sequence[float],
    trials: int = 10,
    seed: int = 777,
    label: str = "label",
) -> tuple[DataFrame, list[LinearFit]]:
    """Random search over weight decays, from the moments of both splits.

    Each split is scanned once, however many trials there are; equal draws are the same fit.
    Returns the metric log ``(run_id, epoch, metric, value)`` and the fits.
    """
    spark, columns = train.sparkSession, [*features, label]
    draws = spark.range(trials).select("id", draw_index(F.lit(len(decays)), seed, "trial", F.col("id")).alias("i"))
    fitted, held_out = (read_moments(moments(df, columns), columns) for df in (train, validation))
    fits = [fitted.solve(decays[r.i]) for r in draws.orderBy("id").collect()]
    rows = []
    for t, fit in enumerate(fits):
        loss, r = held_out.evaluate(fit)
        rows += [(f"trial-{t:03d}", 0, "val_loss", loss), (f"trial-{t:03d}", 0, "val_pearson", r)]
    return spark.createDataFrame(rows, METRICS), fits
