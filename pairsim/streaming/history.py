"""Early stop while metrics arrive.

Each micro-batch is judged by the batch operators, with the state of its runs beside it,
so a run with most of the rows is cut into blocks of epochs as in a table. The state is
one row per run. Two folders take turns: batch ``n`` reads what ``n - 1`` wrote and
overwrites the other, so a batch that is repeated after a failure finds the same state
and writes the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsim.operators.history import BLOCK_EPOCHS, PATIENCE, finite_score, running_max
from pairsim.sources.scratch import durable

STATE = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("best", T.DoubleType()),
        T.StructField("best_epoch", T.LongType()),
        T.StructField("last_epoch", T.LongType()),
        T.StructField("stop_epoch", T.LongType()),
        T.StructField("epochs", T.LongType()),
        T.StructField("late", T.LongType()),
        T.StructField("batch", T.LongType()),
    ]
)


def _slot(folder: str, batch: int) -> str:
    return f"{folder}/state-{batch % 2}"


def read_state(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame:
    """State after ``batch``, the latest one by default; no rows before the first."""
    empty = spark.createDataFrame([], STATE)
    slots = [_slot(folder, i) for i in range(2)]
    for path in slots:
        empty.write.mode("ignore").parquet(path)
    if batch is not None:
        return spark.read.schema(STATE).parquet(_slot(folder, batch)).where(F.col("batch") == batch)
    both = spark.read.schema(STATE).parquet(*slots)
    return both.where(F.col("batch") == both.agg(F.max("batch")).first()[0])


def advance(
    state: DataFrame, arrived: DataFrame, batch: int, patience: int = PATIENCE, block: int = BLOCK_EPOCHS
) -> DataFrame:
    """State after the rows ``(run_id, epoch, value)`` of one micro-batch.

    Epochs are taken in order inside a micro-batch, whatever the order of its rows. An
    epoch at or below the last one of an earlier micro-batch is late or repeated: it is
    counted and changes nothing else. Repeats inside a micro-batch count as late too;
    the largest value stays (not a number above all, which stops the run).
    """
    known = state.select("run_id", "last_epoch", "stop_epoch")
    once = arrived.groupBy("run_id", "epoch").agg(
        F.max(F.struct(F.coalesce(F.col("value"), F.lit(float("nan"))).alias("v"))).alias("top"),
        F.count("*").alias("n"),
    )
    seen = durable(once.join(known, "run_id", "left"))
    is_late = F.coalesce(F.col("epoch") <= F.col("last_epoch"), F.lit(False))
    fresh = seen.where(~is_late).select(
        "run_id", "epoch", F.col("top.v").alias("value"), F.lit(True).alias("fresh")
    )
    best_before = state.where("best IS NOT NULL").select(
        "run_id", F.col("best_epoch").alias("epoch"), F.col("best").alias("value"), F.lit(False).alias("fresh")
    )
    # The best value so far stands as a row of its epoch, before all fresh ones.
    held = best_before.join(fresh.select("run_id").distinct(), "run_id", "left_semi")
    scored = fresh.unionByName(held).withColumn("_score", finite_score())
    ranked = running_max(scored, "_score", "_best", block)
    stop = F.col("_score").isNull() | (F.col("epoch") + F.col("_best.e") >= patience)
    now = ranked.groupBy("run_id").agg(
        F.max("_best").alias("top"),
        F.max("epoch").alias("reached"),
        F.min(F.when(F.col("fresh") & stop, F.col("epoch"))).alias("stopped"),
        F.count_if("fresh").alias("more"),
    )
    late = seen.groupBy("run_id").agg(
        F.sum(F.when(is_late, F.col("n")).otherwise(F.col("n") - 1)).alias("more_late")
    )
    joined = state.join(now, "run_id", "full").join(late, "run_id", "full")
    return joined.select(
        "run_id",
        F.coalesce("top.v", "best").alias("best"),
        F.coalesce(-F.col("top.e"), "best_epoch").alias("best_epoch"),
        F.greatest("reached", "last_epoch").alias("last_epoch"),
        F.coalesce("stop_epoch", "stopped").alias("stop_epoch"),
        (F.coalesce("epochs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("epochs"),
        (F.coalesce("late", F.lit(0)) + F.coalesce("more_late", F.lit(0))).alias("late"),
        F.lit(batch).cast("long").alias("batch"),
    )


def stream_early_stop(history: DataFrame, folder: str, checkpoint: str, patience: int = PATIENCE):
    """Follow a stream of ``(run_id, epoch, value)`` and return the started query.

    The result after each micro-batch is ``read_state(spark, folder)``; ``folder`` and
    ``checkpoint`` belong in storage all executors share.
    """

    def judge(arrived: DataFrame, batch: int) -> None:
        before = read_state(arrived.sparkSession, folder, batch - 1)
        after = advance(before, arrived, batch, patience)
        after.write.mode("overwrite").parquet(_slot(folder, batch))

    return (
        history.writeStream.foreachBatch(judge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
