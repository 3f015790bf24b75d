import math

from pyspark.sql import functions as F

from pairsim.functions import losses, postprocess, similarity, text
from pairsim.functions.seeded import hash_above, draw_hash, u01
from pairsim.plans import tables


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_clean_keeps_unicode_words(spark):
    df = spark.createDataFrame([("한글 A-b, 1!",), ("été_ß ∑ １",)], ["t"])
    got = values(df, text.strip_symbols(F.col("t")), text.clean(F.col("t")))
    assert got[0] == ("한글 A b  1 ", "한글 a b  1 ")
    assert got[1] == ("été_ß   １", "été_ß   １")


def test_words_and_joins(spark):
    df = spark.createDataFrame([("",), ("   ",), (" a  b ",), ("x",)], ["t"])
    ws = text.words(F.col("t"))
    assert values(df, ws, text.join_words(ws)) == [([], ""), ([], ""), (["a", "b"], "a b"), (["x"], "x")]


def test_pair_text_null(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    assert values(df, text.pair_text(F.col("x"), F.col("y"))) == [("a[SEP]b",), (None,)]


def test_keep_script(spark):
    df = spark.createDataFrame([("한ㄱㅏ글 ab 1!",)], ["t"])
    assert values(df, text.keep_script(F.col("t"))) == [("한ㄱㅏ글  ",)]


def test_rounding_and_clip(spark):
    nan = float("nan")
    df = spark.createDataFrame([(x,) for x in (0.25, 0.75, 1.25, -0.04, -0.3, 5.3, nan, None)], "p double")
    got = [r[0] for r in values(df, postprocess.finish_prediction(F.col("p")))]
    assert [g + 0.0 for g in got[:6]] == [0.2, 0.8, 1.2, 0.0, 0.0, 5.0]
    assert math.isnan(got[6]) and got[7] is None


def test_pearson_edges(spark):
    rows = [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("one", 1.0, 1.0), ("up", 1.0, 2.0), ("up", 2.0, 4.0), ("null", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, p double, y double")
    got = dict(values(df.groupBy("g").agg(losses.pearson(F.col("p"), F.col("y")).alias("r")), "g", "r"))
    assert math.isnan(got["flat"]) and math.isnan(got["one"])
    assert abs(got["up"] - 1) < 1e-12 and got["null"] is None


def test_losses(spark):
    df = spark.createDataFrame([(0.0, 0.5), (3.0, 0.0), (1.0, 2.0)], "p double, y double")
    row = df.agg(*[losses.loss(n, F.col("p"), F.col("y")).alias(n) for n in losses.LOSSES]).first()
    assert abs(row.L1 - 4.5 / 3) < 1e-12
    assert abs(row.MSE - (0.25 + 9 + 1) / 3) < 1e-12
    assert abs(row.Huber - (0.125 + 2.5 + 0.5) / 3) < 1e-12
    assert 0 <= row.plcc <= 1


def test_squared_plcc_accepts_anticorrelation(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "p double, y double")
    p, y = F.col("p"), F.col("y")
    row = df.agg(losses.plcc(p, y).alias("a"), losses.plcc(p, y, squared=False).alias("b")).first()
    assert abs(row.a) < 1e-12 and abs(row.b - 2) < 1e-12


def test_similarity(spark):
    df = spark.createDataFrame([("ab cd", "cd ef", "a𝒜bc"), ("", "", "ab")], "a string, b string, c string")
    a, b = similarity.word_set(F.col("a")), similarity.word_set(F.col("b"))
    got = values(
        df,
        similarity.jaccard(a, b),
        similarity.overlap(a, b),
        similarity.length_ratio(F.col("a"), F.col("b")),
        similarity.char_ngrams(F.col("c"), 3),
    )
    assert got == [(1 / 3, 0.5, 1.0, ["a𝒜b", "𝒜bc"]), (0.0, 0.0, 1.0, [])]


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(500)
    results = [
        sorted(values(df.repartition(n), "id", u01(7, F.col("id")).alias("u"))) for n in (1, 4, 13)
    ]
    assert results[0] == results[1] == results[2]
    us = [u for _, u in results[0]]
    assert all(0 <= x < 1 for x in us) and 0.4 < sum(us) / len(us) < 0.6


def test_hash_above_equals_draw(spark):
    df = spark.range(2000)
    h = draw_hash(3, F.col("id"))
    assert df.where(hash_above(h, 0.1) != (u01(3, F.col("id")) > 0.1)).count() == 0


def test_ngrams_of_any_start_and_plane(spark):
    texts = ["", "a", "ab", "abc", "abcd", "\U0001f600b\U0001f601cd\ne", "aaaaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for n in (1, 2, 3):
        for r in df.select("c", similarity.char_ngrams(F.col("c"), n).alias("g")).collect():
            assert sorted(r.g) == sorted({r.c[i : i + n] for i in range(len(r.c) - n + 1)})


def test_a_line_is_prepared_once(spark, tmp_path):
    rows = [(1, "A b c\n\na b\na b c d", "en", "s"), (2, None, None, None), (3, "x", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    scored = tables.scored_pairs(spark, str(tmp_path))
    cleaned = scored._jdf.queryExecution().optimizedPlan().toString()
    assert cleaned.count("\\p{N}_") == 1
    assert [(r.id, r.label) for r in scored.orderBy("id").collect()] == [("1-0", 3.3), ("1-1", 2.5)]
    models = tables.three_models(spark, str(tmp_path)).where("model = 'length'").orderBy("id").collect()
    assert [(r.id, round(r.prediction, 3)) for r in models] == [("1-0", 3.0), ("1-1", 2.143)]
