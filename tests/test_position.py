import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairsim.operators import position, sampling


def ordered(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("n", [0, 1, 7, 20, 90, 9874])
def test_split_sizes(spark, n):
    split = position.split_fractions(spark.range(n), ["id"], partitions=7)
    got = dict(split.groupBy("split").agg(F.count("*"), F.min("id"), F.max("id")).rdd.map(lambda r: (r[0], r[1:])).collect()) if n else {}
    cuts = [0, int(n * 0.7), int(n * 0.85), n]
    for name, a, b in zip(("train", "validation", "test"), cuts, cuts[1:]):
        assert got.get(name) == ((b - a, a, b - 1) if b > a else None)


def test_split_9874():
    assert (int(9874 * 0.7), int(9874 * 0.85) - int(9874 * 0.7), 9874 - int(9874 * 0.85)) == (6911, 1481, 1482)
    assert int(90 * 0.7) == 62


@pytest.mark.parametrize("partitions", [1, 4, 13])
@pytest.mark.parametrize("buckets", [1, 5, 150])
def test_position_is_exact(spark, partitions, buckets):
    # One leading key holds most rows: the second key has to split it.
    rows = [(0 if i % 3 else i, f"k{i:05d}") for i in range(2000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g int, k string").repartition(partitions)
    got = ordered(position.with_position(df, ["g", "k"], partitions=buckets), "pos", "g", "k")
    assert got == [(i, *r) for i, r in enumerate(sorted(rows))]


def test_position_in_groups_with_nulls(spark):
    rows = [(None if i % 5 == 0 else i % 2, i * 37 % 1009) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, k int")
    got = position.with_position(df, ["k"], by=["g"], partitions=20).collect()
    for g in (None, 0, 1):
        mine = sorted((r.pos, r.k) for r in got if r.g == g)
        assert mine == list(enumerate(sorted(k for gg, k in rows if gg == g)))


def test_group_over_many_partitions(spark):
    # Half of the rows are one group; runs of all sizes begin and end inside partitions.
    rows = [(0 if i % 2 else i % 97, i * 7919 % 20011) for i in range(20000)]
    df = spark.createDataFrame(rows, "g int, k int")
    got = position.with_position(df, ["k"], by=["g"], partitions=20).groupBy("g").agg(
        F.count("*").alias("n"), F.min("pos"), F.max("pos"), F.countDistinct("pos")
    )
    assert all(tuple(r)[2:] == (0, r.n - 1, r.n) for r in got.collect())


def test_shuffle_is_a_permutation_and_epochs_differ(spark):
    df = spark.range(1000)
    a, b = (ordered(position.shuffle_rows(df.repartition(p), ["id"], 7, e), "pos", "id") for p, e in ((3, 0), (5, 1)))
    assert [p for p, _ in a] == list(range(1000)) == [p for p, _ in b]
    assert sorted(i for _, i in a) == list(range(1000)) and a != b
    assert a == ordered(position.shuffle_rows(df.repartition(11), ["id"], 7, 0), "pos", "id")


@pytest.mark.parametrize("drop_last,rows", [(True, 1088), (False, 1100)])
def test_batches(spark, drop_last, rows):
    placed = position.with_position(spark.range(1100), ["id"])
    batches = position.assign_batches(placed, 16, drop_last)
    sizes = Counter(r.batch_id for r in batches.collect())
    assert sum(sizes.values()) == rows
    assert set(sizes) == set(range(68 if drop_last else 69))


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 0), (3, 2), (5, 2), (7, 4), (9, 4), (1001, 500)])
def test_sample_sizes(spark, n, expected):
    assert sampling.sample_exact(spark.range(n), 0.5, ["id"], 7).count() == expected


def test_sample_is_stable_and_whole_table_at_one(spark):
    df = spark.range(700)
    picks = [ordered(sampling.sample_exact(df.repartition(p), 0.3, ["id"], 5), "id") for p in (1, 4, 13)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 210
    assert sampling.sample_exact(df, 1.0, ["id"], 5).count() == 700
