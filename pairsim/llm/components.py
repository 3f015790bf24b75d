"""Connected components of a link table, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsim.sources.scratch import durable


#: Links from which on a round is joined by sorting: stored roots repeat, so a table of them is larger than its files.
MANY_LINKS = 200_000


def _least(df: DataFrame) -> DataFrame:
    """Smallest partner per node; summed up before the shuffle, so a hub is cheap."""
    return df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))


def _round(links: DataFrame, many: bool = False) -> DataFrame:
    """One large-star and one small-star step on links with ``a > b``; of ``many`` none are sent to all."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def joined(df: DataFrame, to: DataFrame) -> DataFrame:
        return df.join(to.hint("merge") if many else to, F.col("a") == F.col("node"))

    least = _least(both).withColumn("least", F.least("least", "node"))
    large = (
        joined(both, least)
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )
    least = _least(large)
    small = joined(large, least)
    return (
        small.where(F.col("b") > F.col("least"))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .unionAll(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; root = smallest node.

    Nodes are of any type with an order, structs among them.
    Alternating large-star and small-star steps need a logarithmic number of
    rounds. Each round is written to the shared folder, so no lineage grows and
    a lost executor costs one round at most; only a count and a checksum reach
    the driver. Links may repeat, run in either direction or join a node to
    itself (which adds nothing); links with a null end are ignored.
    """
    links = durable(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = state(links)
    while before[0]:
        links = durable(_round(links, before[0] >= MANY_LINKS))
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
