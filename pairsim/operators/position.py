"""Row positions, positional splits and batches without a single-task sort.

Spark range-partitions and sorts the rows by key; they are stored with their
partition and their place in it, so a retried task cannot renumber them. Only one
count per partition passes a single task, and the running sums are the offsets.

Keys must identify a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsim.functions.seeded import draw_hash, hash_to_unit
from pairsim.sources.scratch import durable

#: Counts that the driver sees when it looks for the bucket of a cut.
CUT_BUCKETS = 16_384
#: Rows of a partition in ``monotonically_increasing_id``.
PLACE_BITS = 33


def _key_struct(keys: Sequence[str | Column]) -> Column:
    cols = [k if isinstance(k, Column) else F.col(k) for k in keys]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])


def _literal(key: Row, dtype: T.StructType) -> Column:
    return F.struct(
        *[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, dtype.fields)]
    )


def hash_bucket(digest: Column, buckets: int = CUT_BUCKETS) -> Column:
    """Equal-width bucket of a hex digest; grows with the digest's order."""
    return F.floor(hash_to_unit(digest) * buckets).cast("int")


def place_in_partition() -> Column:
    """0-based place of a row in its partition."""
    return F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = (),
    name: str = "pos",
    partitions: int | None = None,
    compression: str | None = None,
    unstored: Sequence[str] = (),
    times: str | None = None,
) -> DataFrame:
    """0-based position by ``keys``, counted inside each ``by`` group. The columns ``unstored``
    only give the order and are left out of the result. A row that stands for several takes as many positions as
    its column ``times`` says, one at least; its own is the first of them.

    A group of any size spreads over the partitions its keys span. Of the groups in
    a partition only the first can have begun in an earlier one, so one offset per
    partition is enough; that table is as long as there are partitions.
    """
    spark = df.sparkSession
    if partitions is None:
        configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(configured, 2 * spark.sparkContext.defaultParallelism)
    groups = [F.col(f"`{c}`") for c in by]
    order = [*groups, *[F.col(f"`{c}`") for c in keys]]
    arranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    if times is not None:
        arranged = arranged.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col(times))))
    arranged = arranged.withColumns({"_part": F.spark_partition_id(), "_place": place_in_partition()})
    if times is not None:
        arranged = arranged.where("_time = 1").drop("_time")
    placed = durable(arranged.drop(*unstored), compression)
    n = F.count("*") if times is None else F.sum(times)
    runs = placed.groupBy("_part", *groups).agg(n.alias("_n"), F.min("_place").alias("_start"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        runs.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .where("_start = 0")
        .select("_part", "_offset")
    )
    start = F.lit(0)
    if by:
        start = F.first("_place").over(Window.partitionBy("_part", *groups).orderBy("_place"))
    offset = F.when(F.col("_start") == 0, F.col("_offset")).otherwise(0)
    return (
        placed.withColumn("_start", start)
        .join(F.broadcast(offsets), "_part")
        .select(
            *[F.col(f"`{c}`") for c in df.columns if c not in unstored],
            (F.col("_place") - F.col("_start") + offset).cast("long").alias(name),
        )
    )


def shuffle_rows(
    df: DataFrame, key: Sequence[str], seed: int, epoch: int = 0, name: str = "pos"
) -> DataFrame:
    """Random order of all rows as a position; another ``epoch`` gives another order."""
    h = draw_hash(seed, epoch, "shuffle", *[F.col(f"`{k}`") for k in key])
    return with_position(df.withColumn("_h", h), ["_h", *key], name=name, unstored=["_h"])


def before_cuts(
    df: DataFrame,
    bucket: Column,
    order: Sequence[Column],
    cuts: Sequence[Callable[[int], int]],
) -> list[Column]:
    """For each cut, a condition that holds for exactly the first ``cut(n)`` rows.

    The driver gets the count of each bucket (at most ``CUT_BUCKETS`` numbers)
    and then one key per cut; only the buckets holding a cut are sorted.
    Comparing rows with those keys replaces numbering, sorting or moving them.
    """
    keyed = df.select(bucket.alias("bucket"), _key_struct(order).alias("key"))
    counts = sorted(keyed.groupBy("bucket").agg(F.count("*").alias("n")).collect())
    total = sum(c.n for c in counts)
    wanted: dict[int, tuple[int, int]] = {}
    for i, cut in enumerate(cuts):
        rest = cut(total)
        for c in counts:
            if rest < c.n:
                wanted[i] = (c.bucket, rest + 1)
                break
            rest -= c.n
    found: dict[tuple[int, int], Row] = {}
    if wanted:
        held = keyed.where(F.col("bucket").isin([b for b, _ in wanted.values()]))
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("key"))
        hit = F.struct("bucket", "rank").isin(
            [F.struct(F.lit(b).cast("int"), F.lit(r).cast("int")) for b, r in wanted.values()]
        )
        rows = held.withColumn("rank", rank).where(hit).collect()
        found = {(r.bucket, r.rank): r.key for r in rows}
    dtype = keyed.schema["key"].dataType
    key = _key_struct(order)
    # A cut past the last row takes all rows.
    return [
        key < _literal(found[wanted[i]], dtype) if i in wanted else F.lit(True)
        for i in range(len(cuts))
    ]


# Shares of the table at which the splits end, and their names.
CUTS = (0.7, 0.85)
SPLITS = ("train", "validation", "test")


def split_positions(
    placed: DataFrame,
    cuts: tuple[float, float] = CUTS,
    names: tuple[str, str, str] = SPLITS,
    pos: str = "pos",
) -> DataFrame:
    """Split by a position column at ``int(n * cut)`` (double arithmetic, truncated)."""
    n = placed.count()
    first, second = (F.col(pos) < int(n * c) for c in cuts)
    return placed.withColumn("split", F.when(first, names[0]).when(second, names[1]).otherwise(names[2]))


def split_fractions(
    df: DataFrame,
    keys: Sequence[str],
    cuts: tuple[float, float] = CUTS,
    names: tuple[str, str, str] = SPLITS,
    partitions: int | None = None,
) -> DataFrame:
    """As ``split_positions``, by the order of ``keys``.

    Only the keys are sorted. Rows are compared with the two keys at the cuts; the
    table itself is not shuffled.
    """
    placed = with_position(durable(df.select(*keys)), keys, name="_pos", partitions=partitions)
    n = placed.count()
    at = [int(n * c) for c in cuts]
    key = _key_struct(keys)
    found = placed.select("_pos", key.alias("key"))
    rows = {r["_pos"]: r.key for r in found.where(F.col("_pos").isin(at)).collect()}
    dtype = found.schema["key"].dataType
    # A cut past the last row takes all rows.
    first, second = (key < _literal(rows[p], dtype) if p in rows else F.lit(True) for p in at)
    return df.withColumn("split", F.when(first, names[0]).when(second, names[1]).otherwise(names[2]))


def assign_batches(
    positioned: DataFrame, size: int, drop_last: bool = False, pos: str = "pos"
) -> DataFrame:
    """``batch_id`` from a position column; ``drop_last`` removes an incomplete tail."""
    out = positioned.withColumn("batch_id", F.floor(F.col(pos) / size).cast("long"))
    if drop_last:
        n = positioned.agg(F.count("*")).scalar()
        out = out.where(F.col(pos) < n - n % size)
    return out


def epoch_batches(
    df: DataFrame, key: Sequence[str], seed: int, epoch: int, size: int, drop_last: bool = False
) -> DataFrame:
    """Batches of a fresh order for one epoch."""
    return assign_batches(shuffle_rows(df, key, seed, epoch), size, drop_last)
