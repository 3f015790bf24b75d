"""Prediction post-processing: one decimal, clipped to the label range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label range.
LABEL_MIN = 0.0
LABEL_MAX = 5.0


def round_prediction(p: Column) -> Column:
    """Half-to-even to one decimal on the single-precision value."""
    return F.bround(p.cast("float").cast("double"), 1)


def clip_label(p: Column, low: float = LABEL_MIN, high: float = LABEL_MAX) -> Column:
    """Clip to the label range; NaN stays NaN (Spark orders it above all numbers)."""
    return (
        F.when(F.isnan(p), p)
        .when(p < low, F.lit(low))
        .when(p > high, F.lit(high))
        .otherwise(p)
    )


def finish_prediction(p: Column) -> Column:
    return clip_label(round_prediction(p))
