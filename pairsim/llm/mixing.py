"""Mix sources to target weights by systematic sampling.

All documents of a source are expected equally often: target divided by size.
Laid end to end in a fixed order these expectations fill an interval; with one
random offset per source, a document is taken once for each integer boundary its
part of the interval crosses. The order goes by size class (the first two digits
and the number of digits) and then by a hash, so every class is thinned alike and
the words taken come near the target.

The prefix sum is the row's rank times the rate. Ranks come from two levels:
counts per (source, size class, hash prefix), and a rank inside each of these, so
a source with most of the rows spreads over many tasks.

Defined results: a null text has size 0; null is a source of its own, last in
order; sources without words have target 0 and take nothing; repeated rows are
taken each on its own; the same rows give the same result in any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsim.functions.seeded import draw_hash, u01

#: Fixed values of the mix: weights by rank of source, share of all sizes, ceiling.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2
SEED = 20240917
#: Hex digits of the hash that split a size class; each digit splits by 16.
PREFIX = 2


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def _key(source: Column) -> Column:
    """A non-null stand-in that keeps null apart from every string."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets from ``(key, source, source_size)``, one row per source.

    The level at which all sources fill up: a source stops at its ceiling, the
    rest share what is left by weight. Sorted by ceiling per weight, the sources
    that stop are a prefix, so running sums over this small table find the level.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    df = sizes.withColumn("weight", F.get(weights, (rank % len(WEIGHTS)).cast("int")))
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(CEILING)))
    everything = Window.partitionBy()
    order = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "budget": F.sum("source_size").over(everything) * F.lit(SHARE),
            "stopped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(everything)
            - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("budget") - F.col("stopped")) / F.col("open")
    holds = level * F.col("weight") <= F.col("cap")
    df = df.withColumn("level", F.max(F.when(holds, level)).over(everything))
    target = F.when(
        F.col("level").isNull(), F.col("cap")
    ).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return df.select("key", "source_size", target.alias("target"))


def _size_class(size: Column) -> Column:
    """Grows with the size: number of digits, then the first two digits."""
    digits = size.cast("string")
    return F.length(digits) * 100 + F.rpad(F.substring(digits, 1, 2), 2, "0").cast("int")


def _mixed(docs: DataFrame, seed: int, carried: list[str]) -> DataFrame:
    """Copies per row, with the ``carried`` columns of ``docs`` in a struct ``row``.

    Rows that agree in id, size and source may take each other's rank: they weigh
    the same.
    """
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
        F.col("doc_id").alias("id"),
        F.col("source"),
        word_count(F.col("text")).alias("size"),
        draw_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias("draw"),
    )
    df = df.select(
        "row", "id", "size", "draw", "source", _key(F.col("source")).alias("key"),
        _size_class(F.col("size")).alias("class"), F.substring("draw", 1, PREFIX).alias("part"),
    )
    counts = df.groupBy("key", "class", "part").agg(
        F.count("*").alias("n"), F.sum("size").alias("words"), F.max("source").alias("source")
    )
    sizes = counts.groupBy("key").agg(
        F.max("source").alias("source"), F.sum("words").alias("source_size")
    )
    running = Window.partitionBy("key").orderBy("class", "part")
    before = F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(
        source_targets(sizes), "key"
    )
    parts = Window.partitionBy("key", "class", "part")
    ranked = df.withColumn("rank", F.row_number().over(parts.orderBy("draw", "id", "size")))
    joined = ranked.join(
        offsets.select("key", "class", "part", "before", "source_size", "target"),
        ["key", "class", "part"],
    )
    at = F.col("before") + F.col("rank") - 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = u01(seed, "offset", F.col("key"))
    copies = F.floor((at + 1) * rate + offset) - F.floor(at * rate + offset)
    # Rounding may add a boundary where the rate is at the ceiling.
    copies = F.least(copies, F.lit(CEILING)).cast("long")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)`` per row of ``docs``."""
    return _mixed(docs, seed, ["doc_id"]).select(
        "row.doc_id", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def take(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed table: each row of ``docs`` repeated as often as it is taken."""
    mixed = _mixed(docs, seed, docs.columns)
    copy = F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))
    return mixed.select("row", copy.alias("copy")).select("row.*")


#: DuckDB's form of the query over ``documents``.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-')) AS draw
  FROM documents
), s AS (
  SELECT key, max(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY key
), w AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight
  FROM s
), r AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    coalesce(sum(cap) OVER o, 0) AS stopped, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open
  FROM w WINDOW o AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, max(CASE WHEN (budget - stopped) / open * weight <= cap THEN (budget - stopped) / open END) OVER () AS level
  FROM r
), t AS (
  SELECT key, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM l
), k AS (
  SELECT d.*, t.source_size, t.target,
    row_number() OVER (PARTITION BY d.key ORDER BY length(size::VARCHAR) * 100
      + rpad(substr(size::VARCHAR, 1, 2), 2, '0')::INT, draw, doc_id, size) - 1 AS pos,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('{SEED}|offset|' || d.key), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM d JOIN t USING (key)
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (least(floor((pos + 1) * rate + u) - floor(pos * rate + u), 2) * size)::BIGINT AS taken
FROM k
"""
