import hashlib
import math

import numpy as np
import pytest

from pairsim.llm import kmeans

NAN = float("nan")


def plain(rows, k, rounds, dims, scale=64):
    """Lloyd's rounds in integers, all pairs compared."""
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    cents = [list(v) for i, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found]


def check(spark, rows, k, rounds, dims):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "1 as cluster", "2 as cells", "3 as distance", "4 as digest").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = kmeans.cluster_report(df, k=k, rounds=rounds, dims=dims)
    assert dict(got.dtypes) == {
        "vec_id": "bigint", "cluster": "int", "distance": "bigint",
        "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string",
    }
    got, want = [tuple(r) for r in got.collect()], plain(rows, k, rounds, dims)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


@pytest.mark.parametrize("seed,k,spread", [(1, 4, 0.02), (2, 9, 0.3), (3, 5, 2.0)])
def test_brute_force(spark, seed, k, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, 6))
    rows = [(i, (centres[i % k] + spread * rng.normal(size=6)).tolist()) for i in range(300)]
    check(spark, rows, k, 4, 6)


def test_odd_rows(spark):
    rows = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (None, [3.0, 1.0]), (3, None), (4, []),
            (5, [NAN, 1.0]), (6, [float("inf"), 0.0]), (7, [None, 1.0]), (8, [1.0]), (9, [-0.001, 0.0]), (10, [0.0, 0.0])]
    assert len(check(spark, rows, 3, 2, 2)) == 6
    # Fewer vectors than centroids, and ties: equal vectors take the smaller number.
    assert {r[1] for r in check(spark, rows[:3], 16, 3, 2)} == {0}
    assert check(spark, [], 16, 3, 2) == []
    far = spark.createDataFrame([(1, [2.0e6, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        kmeans.cluster_report(far, dims=2).collect()


def test_bounds_hold_and_save_comparisons():
    """No vector comes nearer to a centroid than loosened; far fewer are compared than all."""
    rng = np.random.default_rng(5)
    for spread in (3.0, 40.0):
        old = rng.integers(-100, 100, (8, 5))
        new = old + rng.integers(-9, 10, (8, 5))
        at = rng.integers(0, 8, 4000)
        x = old[at] + rng.normal(size=(4000, 5)) * spread
        to_old = np.sqrt(((x[:, None] - old) ** 2).sum(-1))
        to_new = np.sqrt(((x[:, None] - new) ** 2).sum(-1))
        radius = np.array([to_old[at == i, i].max() for i in range(8)])
        loose = kmeans.loosening(old, new, radius)
        nearer = to_old - to_new
        nearer[np.arange(4000), at] = -np.inf
        assert (nearer.max(axis=1) <= loose[at] + 1e-9).all()
        longest = np.sqrt(((new - old) ** 2).sum(-1)).max()
        assert (loose <= longest + 1e-9).all()
    cells = rng.integers(-100, 100, (8, 5))
    x = np.repeat(cells, 500, axis=0) + rng.integers(-3, 4, (4000, 5))
    cluster, squared, lower, compared = kmeans.assign(x, cells, np.zeros(4000, np.int64), np.zeros(4000))
    assert compared == 4000
    radius = np.array([np.sqrt(squared[cluster == i].max()) for i in range(8)])
    lower = lower - kmeans.loosening(cells, cells + 1, radius)[cluster]
    again, _, _, compared = kmeans.assign(x, cells + 1, cluster, lower)
    assert compared < 400 and (again == cluster).all()
