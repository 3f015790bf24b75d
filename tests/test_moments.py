import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsim.operators import model, moments

COLUMNS = ["x", "y", "label"]


def table(spark, n=400, seed=1, outliers=0.1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.random(), rng.random()
        label = 3 * x - y + 1 + rng.gauss(0, 0.05)
        rows.append((i, x, y, label + (20 if rng.random() < outliers else 0)))
    rows += [(n, None, 1.0, 1.0), (n + 1, float("nan"), 1.0, 1.0), (n + 2, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "id long, x double, y double, label double"), rows[:n]


def test_moments_add_up(spark):
    df, rows = table(spark)
    whole = moments.moments(df, COLUMNS).first()
    assert whole["n"] == len(rows)
    parts = moments.moments(df.withColumn("p", F.col("id") % 7), COLUMNS, ["p"])
    merged = moments.merge_moments(parts).first()
    z = np.array([[1.0, *r[1:]] for r in rows])
    for got in (whole, merged):
        assert np.allclose(moments.Moments(got, COLUMNS).matrix, z.T @ z)
    assert moments.moments(df.limit(0), COLUMNS).first()["n"] == 0
    with pytest.raises(ValueError):
        moments.fit_ridge(df.limit(0), ["x", "y"])


@pytest.mark.parametrize("decay", [0.0, 0.3])
def test_ridge_and_evaluation(spark, decay):
    df, rows = table(spark)
    fit = moments.fit_ridge(df, ["x", "y"], decay)
    x, y = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    cx, cy = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(cx.T @ cx / len(y) + decay * np.eye(2), cx.T @ cy / len(y))
    assert np.allclose(fit.weights, want) and np.isclose(fit.intercept, y.mean() - x.mean(0) @ want)
    p = fit.intercept + x @ want
    mse, r = moments.read_moments(moments.moments(df, COLUMNS), COLUMNS).evaluate(fit)
    assert np.isclose(mse, ((p - y) ** 2).mean()) and np.isclose(r, np.corrcoef(p, y)[0, 1])
    shown = df.where("x is not null and not isnan(x)").select(fit.prediction().alias("p"), F.expr(fit.sql()).alias("q")).collect()
    assert all(np.isclose(a.p, a.q) for a in shown)


@pytest.mark.parametrize("loss,decay", [("L1", 0.0), ("L1", 0.05), ("Huber", 0.0), ("Huber", 0.05)])
def test_robust_fits_reach_the_minimum(spark, loss, decay):
    df, rows = table(spark, outliers=0.2)
    fit, losses = moments.fit_robust(df.cache(), ["x", "y"], loss, decay, rounds=25)
    x, y = np.array([[1.0, *r[1:3]] for r in rows]), np.array([r[3] for r in rows])

    def objective(b):
        e = np.abs(y - x @ b)
        value = e if loss == "L1" else np.where(e <= 1, 0.5 * e * e, e - 0.5)
        return value.mean() + decay * (b[1:] ** 2).sum()

    found = np.array([fit.intercept, *fit.weights])
    # No step in any direction is better, but for what the smoothed start of absolute values leaves.
    for step in (0.2, 0.02):
        for d in itertools.product((-step, 0, step), repeat=3):
            assert objective(found) <= objective(found + d) + 1e-3
    if not decay:
        assert np.allclose(found, [1, 3, -1], atol=0.35) and losses[-1] <= losses[0] + 1e-9


def test_fitted_pipeline_is_saved_with_its_decay(spark, tmp_path):
    df, _ = table(spark)
    fitted = model.fit_similarity(df, ["x", "y"], "L1", 0.1, rounds=3)
    again = model.load_model(model.save_model(fitted, str(tmp_path), "robust"))
    out = model.score_pairs(again, df)
    assert out.count() == df.count() and out.where("id = 400").first().prediction is None
    fit, _ = moments.fit_robust(df, ["x", "y"], "L1", 0.1, rounds=3)
    want = {r.id: r.p for r in df.where("id < 50").select("id", fit.prediction().alias("p")).collect()}
    got = {r.id: r.prediction for r in out.where("id < 50").collect()}
    assert all(np.isclose(got[i], want[i]) for i in want)


def test_any_number_of_trials_scans_each_split_once(spark):
    df, _ = table(spark)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    once = df.coalesce(1).mapInArrow(counted, df.schema)
    log, fits = model.tune_ridge(once, once, ["x", "y"], [0.0, 0.1, 1.0], trials=25, seed=3)
    assert log.count() == 50 and len(fits) == 25 and len({f.weights for f in fits}) <= 3
    assert seen.value == 2 * df.count()
    again, _ = model.tune_ridge(df, df, ["x", "y"], [0.0, 0.1, 1.0], trials=25, seed=3)
    # Other partitions add up in another order.
    a, b = ([(*r[:3], round(r.value, 9)) for r in x.orderBy("run_id", "metric").collect()] for x in (log, again))
    assert a == b


@pytest.mark.parametrize("seed", range(6))
def test_blend_against_a_grid(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=60)
    bias = rng.normal(size=3) * 0.5
    p = np.stack([y * s + b + rng.normal(size=60) * n for s, b, n in zip((1, 0.3, -0.5), bias, (0.8, 0.4, 1.0))], 1)
    rows = [(*map(float, r), float(v)) for r, v in zip(p, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double")
    for names in (["a", "b"], ["a", "b", "c"]):
        w = moments.fit_blend(df, names)
        x = p[:, : len(names)]
        error = lambda v: ((x @ np.array(v) - y) ** 2).mean()
        found = error([w[n] for n in names])
        assert abs(sum(w.values()) - 1) < 1e-9 and min(w.values()) >= 0
        grid = itertools.product(np.linspace(0, 1, 101), repeat=len(names) - 1)
        assert found <= min(error([*g, 1 - sum(g)]) for g in grid if sum(g) <= 1 + 1e-9) + 1e-9
        assert found <= min(error(e) for e in np.eye(len(names))) + 1e-12
