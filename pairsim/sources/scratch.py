"""Durable intermediate results in the folder the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Whether the shuffle files of a query go when it ends; else they stay until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """A folder all executors share: the named one, else the session's warehouse.

    On a cluster neither may be a driver-local path, so a warehouse without a
    shared scheme is refused unless the master is local.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local" and "://" not in warehouse.removeprefix("file://"):
        raise ValueError(f"set {SETTING}: {warehouse} is not shared between executors")
    return f"{warehouse}/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/pairsim/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    The result has no lineage, survives lost executors and prunes columns; what was shuffled
    for it is no longer on disk. ``compression`` names another codec than the session's, for long texts.
    """
    conf = df.sparkSession.conf
    path = scratch_path(df.sparkSession, "table")
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
