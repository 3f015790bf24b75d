"""Set operations, swap, label split, balancing."""

from collections import Counter

from pyspark.sql import functions as F

from pairsim.operators import balance, pairs, sampling, setops
from pairsim.schema import PAIR, ROW_KEY, VALUE_COLUMNS


def pair_table(spark, n=200):
    rows = []
    for i in range(n):
        label = None if i % 29 == 0 else (0.0 if i % 2 else float(i % 5))
        same = i % 7 == 1
        rows.append((f"r{i}", "s", f"a{i}", f"a{i}" if same else f"b{i}", label, 0.0))
    return spark.createDataFrame(rows, PAIR)


def bag(df, cols):
    return Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def test_swap_twice_is_the_same_bag(spark):
    df = pair_table(spark)
    assert bag(pairs.swap_columns(pairs.swap_columns(df)), df.columns) == bag(df, df.columns)
    swapped = pairs.swap_augment(df)
    assert swapped.count() == 400 and swapped.select(*ROW_KEY).distinct().count() == 400


def test_null_label_stays_with_the_others(spark):
    zero, other = pairs.partition_by_label(pair_table(spark))
    assert zero.count() + other.count() == 200
    assert other.where("label is null").count() == 7 and zero.where("label is null").count() == 0


def test_model_input(spark):
    df = pair_table(spark)
    assert pairs.model_input(df.drop("label")).where("target is null").count() == 200
    assert pairs.model_input(df, drop=["id"]).columns == ["text", "target"]


def test_union_fills_missing_columns(spark):
    df = pair_table(spark, 3)
    assert setops.union_pairs(df, df.drop("label")).where("label is null").count() == 4


def test_null_rows_are_duplicates_of_each_other(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, None)], "a int, b int")
    assert setops.dedup_rows(df).count() == 2
    assert [tuple(r) for r in setops.rows_occurring_once(df).collect()] == [(2, None)]


def test_hot_copies_vanish_from_the_complement(spark):
    df = spark.createDataFrame([("x",)] * 60 + [(f"y{i}",) for i in range(40)], ["v"])
    sample = df.where("v = 'y0'")
    assert setops.sample_complement(sample, df, ["v"]).count() == 39


def test_balance_against_brute_force(spark):
    df = pairs.swap_augment(pair_table(spark))
    out = balance.balance_labels(df, 9)
    rows = [r.asDict() for r in df.collect()]
    zeros = [r for r in rows if r["label"] == 0.0]
    kept_keys = {(r.id, r.variant) for r in sampling.sample_exact(df.where("label = 0"), 0.5, ROW_KEY, 9, "keep").collect()}
    assert len(kept_keys) == round(len(zeros) / 2)
    times = Counter(tuple(r[c] for c in VALUE_COLUMNS) for r in zeros)
    rest = [r for r in zeros if (r["id"], r["variant"]) not in kept_keys and times[tuple(r[c] for c in VALUE_COLUMNS)] == 1]
    roles = Counter(r.role for r in out.collect())
    assert roles == {"kept": len(kept_keys), "relabelled": round(len(rest) / 2), "other": len(rows) - len(zeros)}
    changed = out.where("role = 'relabelled'")
    assert changed.where("sentence_1 <> sentence_2 or label <> 5 or `binary-label` <> 1").count() == 0
    rest_keys = {(r["id"], r["variant"]) for r in rest}
    assert {(r.id, r.variant) for r in changed.collect()} <= rest_keys
    assert changed.where("sentence_1 = concat('a', substr(id, 2)) and variant = 'swap'").count() == 0


def test_balance_same_for_any_partitioning(spark):
    df = pairs.swap_augment(pair_table(spark))
    cols = [*VALUE_COLUMNS, "variant", "role"]
    bags = [bag(balance.balance_labels(df.repartition(p), 9), cols) for p in (1, 4, 13)]
    assert bags[0] == bags[1] == bags[2]
