import math

import numpy as np
import pytest

from pairsim.llm import neardup
from pairsim.llm.queries import REGISTRY

SF = "/root/testdata/sf0.1"


def plain(rows, cosine=0.95):
    ids, vecs = [], []
    for i, (k, v) in enumerate(rows):
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ids.append(i)
            vecs.append(np.array(v, np.float64))
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for m in range(n):
            a, b = vecs[n], vecs[m]
            if len(a) == len(b):
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i] += 1
                    links[ids[m]] += 1
                    root[find(i)] = find(ids[m])
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, links[i], least.get(find(i)), k is not None and least[find(i)] == k) for i, (k, _) in enumerate(rows)]


def check(spark, rows, block=neardup.BLOCK):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "3 as copies", "4 as k1")
    got = [tuple(r) for r in neardup.near_duplicates(df, block=block).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def clusters(seed, sizes, dim=16, spread=0.04):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        base = rng.standard_normal(dim)
        out += [(base + spread * rng.standard_normal(dim)) * rng.uniform(0.5, 2) for _ in range(n)]
    order = rng.permutation(len(out))
    return [(int(i), [float(np.float32(x)) for x in out[j]]) for i, j in enumerate(order)]


@pytest.mark.parametrize("block", [1500, 7])
def test_clusters_and_blocks(spark, block):
    rows = clusters(1, [1] * 60 + [2] * 10 + [45])
    check(spark, rows + [(900 + i, rows[3][1]) for i in range(5)], block)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]),
            (7, [float("nan"), 1.0, 2.0]), (8, [float("inf"), 1.0, 2.0]), (None, v), (9, [1.0, 2.0]), (10, [1.0, 2.0]),
            (11, [-0.0, 1.0]), (12, [0.0, 1.0]), (13, [1e-30, 2e-30, 3e-30]), (14, [3e38, 3e38, 1e38])]
    check(spark, rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neardup.near_duplicates(df).collect() == []


def test_query_recall(spark):
    """Every row comes back, and against brute force nearly all links at the threshold do."""
    rows = REGISTRY["op3_neardup"](spark, SF).collect()
    data = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert sorted(r.vec_id for r in rows) == sorted(d.vec_id for d in data)
    x = np.array([d.embedding for d in data], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95).sum() - len(x)
    assert sum(r.n_links for r in rows) == near


def test_recall_at_threshold(spark):
    """Pairs of exactly the least cosine: at least 0.9 of the links must be found."""
    rng, rows = np.random.default_rng(4), []
    for i in range(300):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.9501 * a + math.sqrt(1 - 0.9501**2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in neardup.near_duplicates(df).collect()) / 2
    assert found >= 0.95 * 300
