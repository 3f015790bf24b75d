"""Left join to a table with one row per key, safe for large and skewed sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsim.sources.scratch import durable

BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 1_000_000
#: Rows of one key that one task takes.
TASK_ROWS = 1_000_000
#: Words with their dictionary rows that one task collects.
TASK_WORDS = 200_000


def spread_by_key(df: DataFrame, key: Sequence[str], words: int = 0) -> DataFrame:
    """Hash-partition rows by key for work that stays inside a row.

    The partition count is explicit: adaptive coalescing looks at bytes and would
    put a small but expensive table into one task. Later groupings on the key
    (or more columns) need no further shuffle. Of a table of so many ``words`` no task gets more
    than about ``TASK_WORDS``, which it can collect again without spilling them.
    """
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = max(configured, 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, -(-words // TASK_WORDS)), *key)


def require_one_row(ok: Column, value: Column) -> Column:
    """``value`` where ``ok``; otherwise several rows share a key and the job fails."""
    message = F.lit("rows share a key: it has to identify a row")
    return F.when(ok, value).otherwise(F.raise_error(message))


def fits_broadcast(
    df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS
) -> bool:
    """Measure a table (rows and serialized text bytes) against the broadcast bound."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    row = df.agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).alias("b")).first()
    return row.n <= max_rows and row.b <= max_bytes


def _level(n: Column) -> Column:
    return F.floor(F.log2(n))


def least_frequent_level(
    counts: DataFrame, table: DataFrame, key: str, max_bytes: int, max_rows: int
) -> int | None:
    """The lowest power of two such that all keys which are at least as frequent stay inside the
    broadcast bound with their table rows; None if there is none. ``counts`` is ``(_h, _n)``; the driver sees a row per power."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])))
    sized = table.select(F.xxhash64(F.col(key)).alias("_h"), size.alias("_b"))
    levels = counts.join(sized, "_h", "left").groupBy(_level(F.col("_n")).alias("level"))
    found = levels.agg(F.count("*").alias("n"), F.coalesce(F.sum("_b"), F.lit(0)).alias("b")).collect()
    rows = used = 0
    least = None
    for r in sorted(found, key=lambda r: -r.level):
        rows, used = rows + r.n, used + r.b
        if rows > max_rows or used > max_bytes:
            break
        least = r.level
    return least


def lookup(
    left: DataFrame,
    table: DataFrame,
    key: str,
    spread: Sequence[str],
    broadcast: bool | None = None,
    task_rows: int = TASK_ROWS,
    counted: DataFrame | None = None,
    place: Sequence[str] | None = None,
    words: int = 0,
) -> DataFrame:
    """``left`` with the columns of ``table`` for its ``key``, NULL where absent.

    A table inside the bound is broadcast. Of a larger one the rows of the most frequent keys are,
    as many as are inside the bound, and only rows with other keys are shuffled, unless
    ``broadcast`` is False. There a key with more than
    ``task_rows`` rows is spread over as many salts as it has ``task_rows`` by a hash
    of the ``spread`` columns, and the table row it meets is repeated once per salt.
    There are at most ``rows / task_rows`` such keys; where that could exceed the
    rows that may be broadcast, the target grows with the number of rows. ``counted``
    has the keys of ``left`` where that is dear to read twice. ``place`` is the key by which
    ``spread_by_key`` has spread ``left``, ``words`` what it was given: what was shuffled goes back there, so that
    grouping by it moves no row with a frequent key.
    """
    split = broadcast is None
    if broadcast is None:
        broadcast = fits_broadcast(table)
    if broadcast:
        return left.join(F.broadcast(table), key, "left")
    h = F.xxhash64(F.col(key))
    counts = durable((left if counted is None else counted).select(h.alias("_h")).groupBy("_h").agg(F.count("*").alias("_n")))
    least = least_frequent_level(counts, table, key, BROADCAST_BYTES, BROADCAST_ROWS) if split else None
    if least is not None:
        frequent = F.broadcast(durable(counts.where(_level(F.col("_n")) >= least).select("_h")))
        counts = counts.where(_level(F.col("_n")) < least)

        def part(df: DataFrame, how: str) -> DataFrame:
            return df.withColumn("_h", h).join(frequent, "_h", how).drop("_h")

        here = part(left, "left_semi").join(F.broadcast(part(table, "left_semi")), key, "left")
        left, table = part(left, "left_anti"), part(table, "left_anti")
    else:
        here = None
    rest = _shuffled(left, table, key, spread, counts, task_rows)
    if here is None:
        return rest
    # Both sides of the union are partitioned alike, which Spark passes on to a grouping.
    return here.unionByName(rest if place is None else spread_by_key(rest, place, words))


def _shuffled(
    left: DataFrame, table: DataFrame, key: str, spread: Sequence[str], counts: DataFrame, task_rows: int
) -> DataFrame:
    """Left join by a shuffle; a key of many rows is spread over salts."""
    h = F.xxhash64(F.col(key))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    target = max(task_rows, total // BROADCAST_ROWS)
    hot = counts.where(F.col("_n") > target).select("_h", F.ceil(F.col("_n") / target).alias("_salts"))
    if hot.isEmpty():
        return left.join(table, key, "left")
    salts = F.coalesce("_salts", F.lit(1))

    def with_salts(df: DataFrame) -> DataFrame:
        return df.withColumn("_h", h).join(F.broadcast(hot), "_h", "left").drop("_h")

    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), salts)
    salted = with_salts(left).withColumn("_salt", salt).drop("_salts")
    each = F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))
    repeated = with_salts(table).withColumn("_salt", each).drop("_salts")
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")
