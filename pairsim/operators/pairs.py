"""Column-level work on pair tables: cleaning, model input, swap, label split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsim.functions import text
from pairsim.schema import LABEL, TEXT_COLUMNS


def clean_pairs(df: DataFrame, lower: bool = True) -> DataFrame:
    fn = text.clean if lower else text.strip_symbols
    return df.withColumns({c: fn(F.col(c)) for c in TEXT_COLUMNS})


def model_input(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Pair text and target; the target is NULL where the table has no label.

    ``id`` stays as row key unless named in ``drop``.
    """
    target = F.col(LABEL).cast("double") if LABEL in df.columns else F.lit(None).cast("double")
    out = df.select(
        *[c for c in ("id", "variant") if c in df.columns],
        text.pair_text(*[F.col(c) for c in TEXT_COLUMNS]).alias("text"),
        target.alias("target"),
    )
    return out.drop(*drop)


def swap_columns(df: DataFrame, a: str = "sentence_1", b: str = "sentence_2") -> DataFrame:
    """Exchange two columns in one projection."""
    crossed = {a: b, b: a}
    return df.select(*[F.col(f"`{crossed.get(c, c)}`").alias(c) for c in df.columns])


def swap_augment(df: DataFrame) -> DataFrame:
    """Every pair in both orders from one scan; ``variant`` tells them apart."""
    s1, s2 = TEXT_COLUMNS

    def option(variant: str, first: str, second: str) -> Column:
        return F.struct(
            F.lit(variant).alias("variant"), F.col(first).alias(s1), F.col(second).alias(s2)
        )

    orders = F.array(option("orig", s1, s2), option("swap", s2, s1))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (s1, s2, "variant")]
    return df.select(*rest, F.inline(orders))


def label_is(label: Column, value: float = 0.0) -> Column:
    """Null-safe label test: a NULL label is never equal, and its negation keeps it."""
    return label.eqNullSafe(F.lit(value))


def partition_by_label(df: DataFrame, value: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Rows with the label and all others, NULL labels among the others."""
    hit = label_is(F.col(LABEL), value)
    return df.where(hit), df.where(~hit)
