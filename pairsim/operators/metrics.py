"""Evaluation of predictions against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsim.functions import losses


def label_distribution(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows and share per label inside each ``by`` group."""
    counts = df.groupBy(*by, "label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def evaluate(
    df: DataFrame,
    by: Sequence[str] = ("split",),
    prediction: str = "prediction",
    label: str = "label",
) -> DataFrame:
    """Rows, Pearson and all losses per group in one aggregate."""
    p, y = F.col(prediction), F.col(label)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        losses.pearson(p, y).alias("pearson"),
        *[fn(p, y).alias(f"loss_{name.lower()}") for name, fn in losses.LOSSES.items()],
    )


def batch_pearson(
    df: DataFrame,
    by: Sequence[str] = (),
    batch: str = "batch_id",
    prediction: str = "prediction",
    label: str = "label",
) -> DataFrame:
    """Pearson per batch, then its mean weighted by batch rows.

    A batch without variance is NaN and makes the plain mean NaN; one without a
    complete pair has no value and weighs in no mean. The mean of
    the defined batches and the number of undefined ones are given beside it.
    """
    per = df.groupBy(*by, batch).agg(
        F.count("*").alias("n"), losses.pearson(F.col(prediction), F.col(label)).alias("r")
    )
    n, r = F.col("n"), F.col("r")
    # Without any complete pair r is NULL: such a batch has no value either.
    undefined = r.isNull() | F.isnan(r)
    defined = ~undefined
    return per.groupBy(*by).agg(
        F.count("*").alias("batches"),
        F.count_if(undefined).alias("undefined_batches"),
        F.try_divide(F.sum(n * r), F.sum(F.when(r.isNotNull(), n))).alias("mean_pearson"),
        F.try_divide(F.sum(F.when(defined, n * r)), F.sum(F.when(defined, n))).alias(
            "mean_defined_pearson"
        ),
    )


def epoch_means(log: DataFrame, metric: str = "train_loss") -> DataFrame:
    """Mean of a logged metric per run and epoch."""
    return (
        log.where(F.col("metric") == metric)
        .groupBy("run_id", "epoch")
        .agg(F.avg("value").alias(metric), F.count("*").alias("steps"))
    )
