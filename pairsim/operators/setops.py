"""Concatenation and duplicates; hot groups shrink in the map-side count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_pairs(*tables: DataFrame, allow_missing: bool = True) -> DataFrame:
    """All rows of all tables by column name, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), tables)


def dedup_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per distinct value; NULLs are equal."""
    return (df.select(*columns) if columns else df).distinct()


def rows_occurring_once(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Values that occur in exactly one row."""
    columns = list(columns or df.columns)
    quoted = [F.col(f"`{c}`") for c in columns]
    return (
        df.groupBy(*quoted).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    )


def sample_complement(sample: DataFrame, full: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``full`` outside ``sample``, where value-duplicated rows vanish too.

    Sampled rows occur at least twice in the union; so do rows that ``full``
    itself repeats. ``exceptAll`` would keep the latter.
    """
    cols = [f"`{c}`" for c in columns]
    return rows_occurring_once(union_pairs(sample.select(*cols), full.select(*cols)))
