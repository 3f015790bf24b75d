import pytest
from pyspark.sql import functions as F

from pairsim.operators import backtranslate, lookup
from pairsim.schema import PAIR


def test_hot_key_is_salted_and_results_equal(spark):
    left = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)))
    left = left.unionByName(spark.createDataFrame([(-1, None)], "id long, k string"))
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 500, 2)], "k string, v int")
    a = lookup.lookup(left, table, "k", ["id"], broadcast=True)
    b = lookup.lookup(left, table, "k", ["id"], broadcast=False, task_rows=100)
    assert "_salt" in b._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(a.collect(), key=repr) == sorted(b.collect(), key=repr)


def test_warm_keys_are_spread_over_even_tasks(spark):
    # A key with 30 % of the rows beside twenty of some size.
    key = F.when(F.col("id") % 10 < 3, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20))
    left = spark.range(40_000).withColumn("k", key)
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(20)], "k string, v int")
    out = lookup.lookup(left, table, "k", ["id"], broadcast=False, task_rows=500)
    assert out.count() == 40_000 and out.where("v is null").isEmpty()
    spread = out.select(F.col("k"), F.pmod(F.xxhash64("id"), F.lit(24)).alias("salt"))
    salted = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in salted
    per_task = spread.where("k = 'hot'").groupBy("salt").count().agg(F.max("count")).first()[0]
    assert per_task < 2 * 500


def test_bound_is_measured(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("word"))
    assert lookup.fits_broadcast(df)
    assert not lookup.fits_broadcast(df, max_rows=999)
    assert not lookup.fits_broadcast(df, max_bytes=100)


@pytest.fixture()
def pairs(spark):
    rows = [("1", "s", "a b", "c d", 1.0, 0.0), ("2", "s", "a b", "a b", 2.0, 0.0), ("3", "s", "q", "zz", 0.0, 0.0)]
    return spark.createDataFrame(rows, PAIR)


def test_back_translation(spark, pairs):
    table = spark.createDataFrame([("a b", "b a"), ("c d", "d c"), ("q", "q")], "text string, back_text string")
    row = backtranslate.back_translate_misses(pairs, table, ["id"]).first()
    assert (row.first_misses, row.total_misses, row.pairs) == (0, 1, 3)
    out = backtranslate.back_translation(pairs, table, ["id"])
    found = sorted((r.id, r.sentence_1, r.sentence_2) for r in out.collect())
    assert [i for i, _, _ in found].count("1") == 8
    assert [f for f in found if f[0] == "2"] == [("2", x, y) for x in ("a b", "b a") for y in ("a b", "b a")]
    assert [f for f in found if f[0] == "3"] == [("3", "q", "zz"), ("3", "zz", "q")]


def test_user_translator_failures_fall_back(spark, pairs):
    def make():
        def translate(text):
            if text == "zz":
                raise ValueError("no translation")
            return text.upper()

        return translate

    table = backtranslate.translate_with(backtranslate.distinct_texts(pairs), make)
    out = {r.id: (r.sentence_1, r.sentence_2) for r in backtranslate.back_translate(pairs, table, ["id"]).collect()}
    assert out == {"1": ("A B", "C D"), "2": ("A B", "A B"), "3": ("Q", "zz")}


def test_rows_of_one_key_are_not_shuffled_after_their_expansion(spark, pairs):
    table = spark.createDataFrame([("a b", "b a"), ("c d", "d c"), ("q", "q")], "text string, back_text string")
    out = backtranslate.back_translation(pairs, table, ["id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    # Rows that agree in all but the texts are still compared with each other.
    twice = pairs.unionByName(pairs).unionByName(pairs.where("id = '1'").selectExpr(
        "id", "source", "sentence_2 as sentence_1", "sentence_1 as sentence_2", "label", "`binary-label`"
    ))
    again = backtranslate.back_translation(twice, table, ["id"], stored=True)
    assert sorted(out.collect(), key=repr) == sorted(again.collect(), key=repr)


def test_texts_are_no_join_keys(spark, pairs):
    table = spark.createDataFrame([("a b", "b a"), (None, "x")], "text string, back_text string")
    nulls = pairs.unionByName(spark.createDataFrame([(None, None, None, "a b", None, None)], PAIR))
    found = backtranslate.attach_back_texts(nulls, table, ["id"], broadcast=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (_digest_1" in plan
    rows = {(r.id, r.sentence_1, r.back_1, r.back_2) for r in found.collect()}
    assert rows == {("1", "a b", "b a", None), ("2", "a b", "b a", "b a"), ("3", "q", None, None), (None, None, None, "b a")}


def test_only_rare_keys_of_a_large_table_are_shuffled(spark, monkeypatch):
    key = F.when(F.col("id") % 4 == 0, "often").when(F.col("id") % 4 == 1, "unknown")
    left = spark.range(4000).withColumn("k", key.when(F.col("id") % 4 == 2, F.concat(F.lit("k"), F.col("id") % 900)))
    table = spark.createDataFrame([("often", 1)] + [(f"k{i}", i) for i in range(600)], "k string, v int")
    whole = lookup.lookup(left, table, "k", ["id"], broadcast=True)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 100)
    seen = []
    shuffled = lookup._shuffled
    monkeypatch.setattr(lookup, "_shuffled", lambda rows, *a: seen.append(rows) or shuffled(rows, *a))
    monkeypatch.setattr(lookup, "fits_broadcast", lambda df: False)
    out = lookup.lookup(left, table, "k", ["id"])
    assert sorted(out.collect(), key=repr) == sorted(whole.collect(), key=repr)
    # Neither the frequent key nor the frequent one that the table lacks, nor NULL.
    assert seen[0].count() == 1000 and seen[0].where("k in ('often', 'unknown') or k is null").isEmpty()
