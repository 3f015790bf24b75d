"""Linear fits from sums of products that add up over any grouping of rows.

A table of moments holds, per group, the sum of the weights and of the weighted products of each two
columns and of each column with one. Tables of parts of the rows merge by
adding. Whatever least squares needs comes from such a row: the fit itself for any weight decay, its
mean squared error and its correlation on the same or on other rows. So
any number of trials costs one scan of each split, and the driver sees one row per group, whose size is the
square of the number of columns.

Losses other than squares are fitted by iteratively reweighted least squares: each round
scans the rows once, with the last round's residuals as weights.

The products are plain sums in double precision: columns should be scaled, as similarities
and labels are. Rows with a null or NaN in one of the columns take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: where the Huber loss turns from squares to absolute values.
DELTA = 1.0
#: Residuals below this count as this in the weights of absolute errors.
LEAST_RESIDUAL = 1e-3
ROUNDS = 20


def _product(i: int, j: int) -> str:
    return f"s{i}_{j}"


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight: Column | None = None, **more: Column) -> DataFrame:
    """``(by..., n, s0_0, s0_1, ...)``: rows and summed products; place 0 stands for one.

    ``more`` are further aggregates over the same rows.
    """
    values = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in columns]]
    usable = F.lit(True)
    for v in values[1:]:
        usable = usable & v.isNotNull() & ~F.isnan(v)
    w = F.lit(1.0) if weight is None else weight
    sums = [
        F.coalesce(F.sum(w * values[i] * values[j]), F.lit(0.0)).alias(_product(i, j))
        for i in range(len(values))
        for j in range(i, len(values))
    ]
    extra = [c.alias(name) for name, c in more.items()]
    return df.where(usable).groupBy(*by).agg(F.count("*").alias("n"), *sums, *extra)


def merge_moments(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of coarser groups, added up from those of parts."""
    sums = [c for c in table.columns if c == "n" or (c[0] == "s" and c[1:].replace("_", "").isdigit())]
    return table.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])


@dataclass(frozen=True)
class LinearFit:
    """``intercept + sum(weights * features)``."""

    features: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]

    def prediction(self) -> Column:
        out = F.lit(self.intercept)
        for name, w in zip(self.features, self.weights, strict=True):
            out = out + F.lit(w) * F.col(f"`{name}`").cast("double")
        return out

    def sql(self) -> str:
        """The same as SQL text."""
        terms = [f"{self.intercept!r}D"]
        terms += [f"{w!r}D * CAST(`{f}` AS DOUBLE)" for f, w in zip(self.features, self.weights, strict=True)]
        return " + ".join(terms)


class Moments:
    """One row of a table of moments; the last column is the label, the others features."""

    def __init__(self, row, columns: Sequence[str]):
        self.columns, k = tuple(columns), len(columns) + 1
        self.n = row["n"]
        self.matrix = np.empty((k, k))
        for i in range(k):
            for j in range(i, k):
                self.matrix[i, j] = self.matrix[j, i] = row[_product(i, j)]

    def solve(self, decay: float = 0.0) -> LinearFit:
        """Minimum of mean(w (label - p)^2) + decay * sum of squared weights, mean over rows.

        Where the features don't determine it, the shortest solution.
        """
        if not self.n:
            raise ValueError("no complete row to fit")
        a = self.matrix[:-1, :-1] / self.n
        penalty = np.diag([0.0, *[decay] * (len(a) - 1)])
        found = np.linalg.lstsq(a + penalty, self.matrix[:-1, -1] / self.n, rcond=1e-12)[0]
        return LinearFit(self.columns[:-1], float(found[0]), tuple(map(float, found[1:])))

    def evaluate(self, fit: LinearFit) -> tuple[float, float]:
        """Mean squared error and correlation of a fit on these rows; NaN without variance."""
        if not self.n:
            return float("nan"), float("nan")
        b = np.array([fit.intercept, *fit.weights])
        m = self.matrix / self.n
        of_p, with_y = b @ m[:-1, :-1] @ b, b @ m[:-1, -1]
        mse = of_p - 2 * with_y + m[-1, -1]
        mean_p, mean_y = b @ m[0, :-1], m[0, -1]
        spread = (of_p - mean_p**2) * (m[-1, -1] - mean_y**2)
        r = (with_y - mean_p * mean_y) / np.sqrt(spread) if spread > 0 else float("nan")
        return float(max(mse, 0.0)), float(r)


def read_moments(table: DataFrame, columns: Sequence[str]) -> Moments:
    """The single row of an ungrouped table of moments."""
    return Moments(table.first(), columns)


def fit_ridge(df: DataFrame, features: Sequence[str], decay: float = 0.0, label: str = "label") -> LinearFit:
    columns = [*features, label]
    return read_moments(moments(df, columns), columns).solve(decay)


def fit_robust(
    df: DataFrame,
    features: Sequence[str],
    loss: str = "L1",
    decay: float = 0.0,
    rounds: int = ROUNDS,
    label: str = "label",
) -> tuple[LinearFit, list[float]]:
    """Minimise mean loss + decay * sum of squared weights, and the mean loss before each round.

    Starts from least squares. A round bounds the loss from above by a parabola that touches it at the
    last residuals, and takes its minimum; so the loss never rises. ``df`` is
    scanned ``rounds`` + 1 times and should be stored.
    """
    columns = [*features, label]
    fit = read_moments(moments(df, columns), columns).solve(decay)
    losses = []
    for _ in range(rounds):
        away = F.abs(F.col(f"`{label}`").cast("double") - fit.prediction())
        if loss == "L1":
            weight, value = 1.0 / F.greatest(away, F.lit(LEAST_RESIDUAL)), away
        elif loss == "Huber":
            weight = F.when(away <= DELTA, 1.0).otherwise(DELTA / away)
            value = F.when(away <= DELTA, 0.5 * away * away).otherwise(DELTA * (away - 0.5 * DELTA))
        else:
            raise ValueError(f"no reweighting for {loss}")
        row = moments(df, columns, weight=weight, loss=F.avg(value)).first()
        losses.append(row["loss"])
        # The parabolas are half the weighted squares.
        fit = Moments(row, columns).solve(2 * decay)
    return fit, losses


def fit_blend(df: DataFrame, models: Sequence[str], label: str = "label") -> dict[str, float]:
    """Weights of a blend of prediction columns: at least 0, together 1, least mean squared error.

    An active set over the moments: the model with the most negative weight is left out until none is;
    one that would lower the error again comes back.
    """
    columns = [*models, label]
    found = read_moments(moments(df, columns), columns)
    if not found.n:
        raise ValueError("no complete row to fit")
    m = found.matrix / found.n
    gram, target, k = m[1:-1, 1:-1], m[1:-1, -1], len(models)
    held = set(range(k))
    best = None
    for _ in range(4 * k + 4):
        at = sorted(held)
        # Least squares with the sum held at one, by its Lagrange multiplier.
        system = np.zeros((len(at) + 1, len(at) + 1))
        system[:-1, :-1] = gram[np.ix_(at, at)]
        system[:-1, -1] = system[-1, :-1] = 1.0
        solved = np.linalg.lstsq(system, np.append(target[at], 1.0), rcond=1e-12)[0]
        weights = np.zeros(k)
        weights[at] = solved[:-1]
        if weights.min() < -1e-12:
            held.discard(int(weights.argmin()))
            continue
        error = weights @ gram @ weights - 2 * weights @ target
        if best is not None and error >= best[0] - 1e-15:
            break
        best = (error, weights)
        slope = gram @ weights - target
        outside = [i for i in range(k) if i not in held and slope[i] < slope[at].min() - 1e-12]
        if not outside:
            break
        held.add(min(outside, key=lambda i: slope[i]))
    weights = np.clip(best[1], 0.0, None)
    return dict(zip(models, (weights / weights.sum()).tolist(), strict=True))
