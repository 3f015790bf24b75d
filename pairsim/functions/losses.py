"""Aggregate columns: Pearson and the losses by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(p: Column, y: Column) -> Column:
    """Pearson correlation; NaN on zero variance, NULL on no rows.

    ``corr`` raises on zero variance in ANSI mode, the moment form does not.
    Rows where either side is NULL count on neither side.
    """
    both = p.isNotNull() & y.isNotNull()
    p, y = F.when(both, p), F.when(both, y)
    r = F.try_divide(F.covar_pop(p, y), F.stddev_pop(p) * F.stddev_pop(y))
    return F.when(F.count(p) > 0, F.coalesce(r, F.lit(float("nan"))))


def l1(p: Column, y: Column) -> Column:
    return F.avg(F.abs(p - y))


def mse(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def huber(p: Column, y: Column, delta: float = 1.0) -> Column:
    e = F.abs(p - y)
    return F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))


def plcc(p: Column, y: Column, squared: bool = True) -> Column:
    """1 - corr^2 by default, so corr = -1 also scores 0; ``squared=False`` gives 1 - corr."""
    r = pearson(p, y)
    return F.lit(1.0) - (r * r if squared else r)


# Loss names.
LOSSES = {"L1": l1, "MSE": mse, "Huber": huber, "plcc": plcc}


def loss(name: str, p: Column, y: Column) -> Column:
    return LOSSES[name](p, y)
