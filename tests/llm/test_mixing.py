import re
from collections import defaultdict

import pytest

from compare import connect, differences
from pairsim.llm import mixing
from pairsim.llm.queries import REGISTRY, SQL

SF = "/root/testdata/sf0.001"


def plain_targets(sizes):
    """Reshare the excess by weight until no source is above its ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    rest, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / total for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(out[s] for s in over)
        free -= over
    return out


def check(rows, docs):
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {d: s for d, s, _ in docs}
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in docs}
    for d, s, _ in docs:
        sizes[s] += words[d]
    targets = plain_targets(sizes)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == words[r.doc_id] and r.source_size == sizes[s]
        assert r.target == pytest.approx(targets[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    return {s: (taken[s], targets[s]) for s in sizes}


def test_query(spark):
    rows = REGISTRY["op8_mixing"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()
    assert len(rows) == len(docs)
    check(rows, [tuple(d) for d in docs])
    assert differences(REGISTRY["op8_mixing"](spark, SF), connect(SF), SQL["op8_mixing"]) == []


def test_near_target_and_stable(spark):
    docs = [(i, ["a", "b", "c", None, "é"][i % 7 % 5], "w " * (i * 37 % 200)) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mixing.mix(df).collect()
    for took, target in check(rows, docs).values():
        assert took == pytest.approx(target, rel=0.02)
    again = mixing.mix(df.repartition(13)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    taken = mixing.take(df)
    assert taken.columns == df.columns and taken.count() == sum(r.copies for r in rows)


def test_odd_rows(spark):
    rows = [(1, "a", None), (1, "a", None), (None, None, "x y"), (None, None, "x y"), (3, "b", ""), (4, "b", " \n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as row", "3 as key")
    got = mixing.mix(df).collect()
    assert len(got) == 6 and all(r.taken <= 2 * r.size for r in got)
    assert {(r.source_size, r.target) for r in got if r.doc_id is None} == {(4, 6.0)}
    assert {r.target for r in got if r.doc_id} == {0.0}
    assert mixing.take(df).columns == df.columns
    assert mixing.mix(df.limit(0)).collect() == []
