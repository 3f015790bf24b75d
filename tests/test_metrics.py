import math
import random

import pytest
from pyspark.sql import functions as F

from pairsim.operators import history, metrics, submission


def table(spark, runs):
    rows = [(r, e, v) for r, vs in runs.items() for e, v in enumerate(vs)]
    return spark.createDataFrame(rows, "run_id string, epoch long, value double")


def py_stop(vs, patience):
    best, waited = -math.inf, 0
    for e, v in enumerate(vs):
        if v is None or not math.isfinite(v):
            return e
        if v > best:
            best, waited = v, 0
        else:
            waited += 1
            if waited >= patience:
                return e
    return None


@pytest.mark.parametrize("block", [3, 65536])
def test_early_stop(spark, block):
    nan = float("nan")
    r = random.Random(5)
    runs = {
        "plateau": [0.1, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2],
        "tie": [0.5, 0.5, 0.6, 0.6],
        "nan": [0.1, nan, 0.2],
        "nan first": [nan, 0.1],
        "never": [0.1 * i for i in range(30)],
        "long": [r.random() for _ in range(300)],
        **{f"r{i}": [round(r.random(), 1) for _ in range(r.randint(1, 25))] for i in range(30)},
    }
    for patience in (1, 3, 5):
        got = {x.run_id: x.stop_epoch for x in history.early_stop(table(spark, runs), patience, block).collect()}
        assert got == {k: py_stop(v, patience) for k, v in runs.items()}


def test_top_checkpoints_and_best_trial(spark):
    runs = {"a": [1.0, 3.0, 3.0, 2.0, float("nan"), 0.0], "b": [0.0]}
    top = [(r.run_id, r.epoch, r.rank) for r in history.top_checkpoints(table(spark, runs)).collect()]
    assert sorted(top) == [("a", 0, 4), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 0, 1)]
    low = history.best_trial(table(spark, runs)).first()
    high = history.best_trial(table(spark, runs), "maximize").first()
    assert (low.run_id, low.value, high.run_id, high.value) == ("a", 0.0, "a", 3.0)


def test_rank_limit_runs_before_the_shuffle(spark):
    plan = history.top_checkpoints(table(spark, {"a": [1.0]}))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_batch_pearson_with_flat_batch(spark):
    rows = [(0, 1.0, 1.0), (0, 2.0, 2.0), (1, 1.0, 2.0), (1, 2.0, 1.0), (1, 3.0, 0.0), (2, 1.0, 0.0), (2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "batch_id long, prediction double, label double")
    row = metrics.batch_pearson(df).first()
    assert (row.batches, row.undefined_batches) == (3, 1) and math.isnan(row.mean_pearson)
    assert abs(row.mean_defined_pearson - (2 * 1 + 3 * -1) / 5) < 1e-9


def test_label_distribution(spark):
    df = spark.createDataFrame([("t", 0.0), ("t", 0.0), ("t", 1.0), ("v", None)], "split string, label double")
    got = {(r.split, r.label): (r.n, r.share) for r in metrics.label_distribution(df).collect()}
    assert got[("t", 0.0)] == (2, 2 / 3) and got[("v", None)] == (1, 1.0)


def test_ensemble_and_submission(spark):
    preds = spark.createDataFrame([("m", "1", 1.0), ("n", "1", 4.0), ("m", "2", 7.0), ("other", "1", 99.0)], "model string, id string, prediction double")
    blended = submission.ensemble_weighted(preds, {"m": 2.0, "n": 1.0})
    assert {r.id: r.prediction for r in blended.collect()} == {"1": 2.0, "2": 7.0}
    template = spark.createDataFrame([("1",), ("2",), ("3",)], ["id"])
    out = submission.build_submission(template, blended)
    assert {r.id: r.target for r in out.collect()} == {"1": 2.0, "2": 5.0, "3": None}
    assert tuple(submission.missing_predictions(out).first()) == (3, 1)


def test_epoch_means(spark):
    log = spark.createDataFrame([("a", 0, "train_loss", 1.0), ("a", 0, "train_loss", 3.0), ("a", 0, "x", 9.0)], "run_id string, epoch long, metric string, value double")
    assert [tuple(r) for r in metrics.epoch_means(log).select("run_id", "epoch", "train_loss", "steps").collect()] == [("a", 0, 2.0, 2)]
