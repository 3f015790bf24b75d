"""Choices over metric histories: early stop, best checkpoints, best trial.

A run may hold a large share of all rows, so running values are built from
blocks of epochs: per-block maxima, a prefix over the blocks of a run, then a
window inside each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_EPOCHS = 65_536
PATIENCE = 5
TOP_K = 4


def running_max(df: DataFrame, value: str, name: str, block: int = BLOCK_EPOCHS) -> DataFrame:
    """Running maximum of ``value`` over the epochs of each run, the row included;
    NULLs are skipped. Epochs are dense integers.
    """
    b = df.withColumn("_block", F.floor(F.col("epoch") / block))
    blocks = b.groupBy("run_id", "_block").agg(F.max(value).alias("_top"))
    over_blocks = Window.partitionBy("run_id").orderBy("_block")
    carried = blocks.select(
        "run_id",
        "_block",
        F.max("_top").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
    )
    inside = (
        Window.partitionBy("run_id", "_block")
        .orderBy("epoch")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        b.join(carried, ["run_id", "_block"])
        .withColumn(name, F.greatest("_carry", F.max(value).over(inside)))
        .drop("_block", "_carry")
    )


def finite_score() -> Column:
    """(value, -epoch), so that the larger is the better and a tie the earlier; NULL
    where the value is not finite."""
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(finite, F.struct(v.alias("v"), (-F.col("epoch")).alias("e")))


def early_stop(
    history: DataFrame, patience: int = PATIENCE, block: int = BLOCK_EPOCHS
) -> DataFrame:
    """First epoch of each run at which the value has not improved for
    ``patience`` checks, or is not finite; NULL when the run never stops.

    A tie is no improvement, so the last improvement is the earliest epoch that
    holds the best value so far: the running maximum of (value, -epoch).
    """
    scored = history.withColumn("_score", finite_score())
    best = running_max(scored, "_score", "_best", block)
    stop = F.col("_score").isNull() | (F.col("epoch") + F.col("_best.e") >= patience)
    return best.groupBy("run_id").agg(
        F.min(F.when(stop, F.col("epoch"))).alias("stop_epoch"), F.count("*").alias("epochs")
    )


def top_checkpoints(history: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` best epochs of each run, the earlier one first on a tie.

    The rank limit is applied before the shuffle, so a large run sends ``k``
    rows per task.
    """
    w = Window.partitionBy("run_id").orderBy(F.desc("value"), F.asc("epoch"))
    return (
        history.where(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("run_id", "epoch", "value", "rank")
    )


def best_trial(history: DataFrame, goal: str = "minimize") -> DataFrame:
    """The run with the best value of all runs; the smaller run id on a tie."""
    usable = history.where(F.col("value").isNotNull() & ~F.isnan("value"))
    sign = 1 if goal == "minimize" else -1
    best = usable.agg(F.min(F.struct((sign * F.col("value")).alias("s"), F.col("run_id"))).alias("b"))
    return best.select("b.run_id", (sign * F.col("b.s")).alias("value"))
