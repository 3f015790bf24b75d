from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pairsim.operators import features, model, vocab
from pairsim.schema import PAIR


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(600).select(
        "id",
        ((F.col("id") * 37) % 101 / 101.0).alias("x"),
        ((F.col("id") * 53) % 97 / 97.0).alias("y"),
    )
    return df.withColumn("label", 3 * F.col("x") - F.col("y") + 1).withColumn(
        "split", F.when(F.col("id") < 400, "train").otherwise("validation")
    )


@pytest.mark.parametrize("loss", ["MSE", "plcc", "Huber", "L1"])
def test_fits(data, loss):
    fitted = model.fit_similarity(data.where("split = 'train'"), ["x", "y"], loss)
    rows = {r.split: r for r in model.evaluate_model(fitted, data).collect()}
    assert rows["validation"].n == 200 and rows["validation"].pearson > 0.9


def test_save_load_and_whole_output(spark, data, tmp_path):
    fitted = model.fit_similarity(data, ["x", "y"], "MSE")
    path = model.save_model(fitted, str(tmp_path), "org/name", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("org_name_20240102_030405")
    a, b = (model.score_pairs(m, data).select("id", "prediction") for m in (fitted, model.load_model(path)))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 600


def test_user_scorer_keeps_every_row(spark):
    df = spark.range(1100).select("id", F.lit("ab").alias("sentence_1"), F.lit("abcd").alias("sentence_2"))

    def load():
        return lambda batch: batch.sentence_1.str.len() / batch.sentence_2.str.len()

    out = model.score_with(df, load)
    assert out.where("prediction = 0.5").count() == 1100


def test_tuning_is_seeded(data):
    train, val = data.where("split = 'train'"), data.where("split = 'validation'")
    args = (["x", "y"], {"regParam": [0.0, 1.0], "elasticNetParam": [0.0, 0.5]})
    (a, models), (b, _) = (model.tune_similarity(train, val, *args, trials=3, seed=5) for _ in range(2))
    assert len(models) == 3 and a.count() == 6
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_encoding(spark):
    rows = [("1", "s", "b a a", "c", 0.0, 0.0), ("2", "s", "", "", 0.0, 0.0), ("3", "s", "a " * 50, "b", 0.0, 0.0), ("4", "s", "new", "a", 0.0, 0.0)]
    df = spark.createDataFrame(rows, PAIR)
    voc = vocab.build_vocab(df.where("id < 4"))
    assert {r.word: r.word_id for r in voc.collect()} == {"a": 4, "b": 5, "c": 6}
    for broadcast in (True, False):
        got = {r.id: r.input_ids for r in vocab.encode_pad(df, voc, ["id"], 10, broadcast=broadcast).collect()}
        assert got["1"] == [2, 5, 4, 4, 3, 6, 3, 0, 0, 0]
        assert got["2"] == [2, 3, 3, 0, 0, 0, 0, 0, 0, 0]
        assert got["3"] == [2, 4, 4, 4, 4, 4, 4, 4, 4, 3]
        assert got["4"] == [2, 1, 3, 4, 3, 0, 0, 0, 0, 0]
    assert vocab.build_vocab(df, size=2).count() == 2


def test_tfidf_paths_agree(spark):
    rows = [(str(i), "s", f"w{i % 7} w{i % 3} hot", f"w{i % 5} hot", 0.0, 0.0) for i in range(60)] + [("e", "s", "", "x", 0.0, 0.0)]
    df = spark.createDataFrame(rows, PAIR)
    a, b = (
        {r.id: round(r.tfidf_cosine, 9) for r in features.tfidf_cosine(df, ["id"], broadcast=x).collect()}
        for x in (True, False)
    )
    assert a == b and len(a) == 61 and a["e"] == 0.0
