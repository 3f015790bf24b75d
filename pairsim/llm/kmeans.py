"""Integer centroid clustering, sped up by geometric drift tightening.

Every vector keeps a lower bound on its distance to all centroids but its own. When
centroids move, the bounds of a cluster are loosened. Full drift would loosen them by
the longest way any centroid went; but the cluster lies in a sphere, and from inside it
a centroid comes nearer by less. For a centroid that moves from c to c' by v, with m
half-way, and any x,

    |x - c| - |x - c'| = 2 (x - m).v / (|x - c| + |x - c'|) <= |v| cos(x - m, v),

since the two distances add up to 2 |x - m| at least. Seen from m, in the plane through
the sphere's centre a and the way v, the sphere with radius r spans the angle
asin(r / |a - m|) to either side of a. So the bound loosens by |v| cos(angle of a less
that span), not at all where this is negative, and by |v| where m lies in the sphere.

A vector nearer to its own moved centroid than its loosened bound keeps its cluster
without being compared; any other is ambiguous and compared with all centroids. All distances that
decide are exact integers; the bounds, in double precision, have a margin.

Vectors are dealt once and stay where they are: each round writes them with cluster
and bound to the shared folder, and sums, counts and radii come from one aggregate
that is summed up before the shuffle, so a cluster of any size is cheap. The driver sees
``k`` centroids only.

Defined results: vectors that are null, of another length, or with a null or
non-finite component are left out; rows of null ``vec_id`` take part, but start no
centroid while there are others; rows that share an id or repeat are vectors of
their own; with fewer than ``k`` vectors each starts a centroid; an empty table gives
no rows. A component beyond ``LIMIT`` steps fails the job, as squared distances would
pass 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from pairsim.sources.scratch import durable

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
LIMIT = 1 << 26
#: Share of a distance by which a bound has to be clear of it.
MARGIN = 1e-9
#: Vectors that are compared with the centroids at a time.
_ROWS = 4096


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, cells array<int>)``: floor(scale * x) of the components of usable vectors."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    message = F.lit(f"a component is beyond {LIMIT} steps of 1 / {scale}")

    def cell(x):
        return F.when(F.abs(x) * scale < LIMIT, F.floor(x * scale).cast("int")).otherwise(F.raise_error(message))

    kept = vectors.where((F.size("embedding") == dims) & ~bad)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, cell).alias("cells"))


def start_centroids(cells: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The vectors of the ``k`` smallest digests of ``seed:vec_id``, in their order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = cells.select(digest.alias("digest"), "cells").orderBy(F.col("digest").asc_nulls_last(), "cells")
    return np.array([r.cells for r in first.limit(k).collect()], np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Per cluster, how much nearer another centroid can have come to any vector of it."""
    k = len(old)
    out = np.zeros(k)
    ways = (new - old).astype(np.float64)
    lengths = np.sqrt((ways * ways).sum(axis=1))
    middles = old + ways / 2
    for i in range(k):
        for j in range(k):
            if j == i or lengths[j] == 0:
                continue
            seen = old[i] - middles[j]
            far = np.sqrt((seen * seen).sum())
            share = 1.0
            if far > radius[i]:
                angle = np.arccos(np.clip(seen @ ways[j] / (far * lengths[j]), -1, 1))
                share = max(0.0, np.cos(max(0.0, angle - np.arcsin(radius[i] / far))))
            out[i] = max(out[i], lengths[j] * share)
    return out


def assign(
    cells: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, lower: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New cluster, squared distance to its centroid, lower bound, and vectors compared."""
    diff = cells - centroids[cluster]
    squared = np.einsum("ij,ij->i", diff, diff)
    own = np.sqrt(squared.astype(np.float64))
    at = np.flatnonzero(~(own + MARGIN * (1 + own) < lower))
    if len(at):
        x = cells[at]
        every = (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)
        # The first of equal ones has the smallest number.
        nearest = every.argmin(axis=1)
        cluster, lower = cluster.copy(), lower.copy()
        cluster[at], squared[at] = nearest, every[np.arange(len(at)), nearest]
        lower[at] = np.inf
        if len(centroids) > 1:
            lower[at] = np.sqrt(np.partition(every, 1, axis=1)[:, 1].astype(np.float64))
    return cluster, squared, lower, len(at)


_STATE = pa.schema(
    [
        ("vec_id", pa.int64()),
        ("cells", pa.list_(pa.int32())),
        ("cluster", pa.int32()),
        ("distance", pa.int64()),
        ("lower", pa.float64()),
        ("compared", pa.bool_()),
    ]
)


def _assigned(state: DataFrame, centroids: np.ndarray, loosened: np.ndarray) -> DataFrame:
    """``state`` with every vector at its nearest of the moved centroids."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                cells = part.column(1).flatten().to_numpy(zero_copy_only=False)
                cells = cells.astype(np.int64).reshape(part.num_rows, centroids.shape[1])
                before = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                lower = part.column(3).to_numpy(zero_copy_only=False) - loosened[before]
                cluster, squared, bound, _ = assign(cells, centroids, before, lower)
                made = [cluster.astype(np.int32), squared, bound, bound != lower]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *map(pa.array, made)], schema=_STATE
                )

    return state.select("vec_id", "cells", "cluster", "lower").mapInArrow(run, from_arrow_schema(_STATE))


def _totals(state: DataFrame, dims: int) -> dict:
    """Per cluster: vectors, squared radius, inertia and componentwise sums; ``k`` rows."""
    sums = [F.sum(F.get("cells", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)]
    rows = state.groupBy("cluster").agg(
        F.count("*").alias("n"), F.max("distance").alias("far"), F.sum("distance").alias("inertia"), *sums
    )
    return {r.cluster: r for r in rows.collect()}


def cluster_vectors(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cells, cluster, distance, compared)`` per usable vector, and the centroids.

    ``compared`` tells whether the last assignment had to compare the vector with all
    centroids.
    """
    cells = durable(integer_vectors(vectors, dims, scale))
    centroids = start_centroids(cells, k, seed)
    if not len(centroids):
        return cells.limit(0).selectExpr("*", "0 as cluster", "0L as distance", "true as compared"), centroids
    # Nothing is known before the first assignment: every vector is ambiguous.
    state = cells.select("*", F.lit(0).alias("cluster"), F.lit(0.0).alias("lower"))
    state = durable(_assigned(state, centroids, np.zeros(len(centroids))))
    for _ in range(rounds):
        totals = _totals(state, dims)
        moved, radius = centroids.copy(), np.zeros(len(centroids))
        for i, r in totals.items():
            moved[i] = [r[f"s{d}"] // r.n for d in range(dims)]
            radius[i] = np.sqrt(float(r.far)) * (1 + MARGIN)
        loosened = loosening(centroids, moved, radius)
        centroids = moved
        state = durable(_assigned(state, centroids, loosened))
    return state.drop("lower"), centroids


def cluster_report(vectors: DataFrame, **settings) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` per vector."""
    found, centroids = cluster_vectors(vectors, **settings)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    fields = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    total = sum(sums.values())
    rows = [
        (i, sums[i], total, hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest())
        for i in sorted(sums)
    ]
    # One row per centroid, so the number of centroids bounds what is broadcast.
    known = vectors.sparkSession.createDataFrame(rows, T._parse_datatype_string(fields))
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _round_sql(i: int) -> str:
    """Assignment ``a{i}`` to the centroids ``c{i}``, and the moved centroids."""
    floor = "((s - ((s % n) + n) % n) // n)"
    return f"""
    a{i} AS MATERIALIZED (
      SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
        SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d
        FROM v JOIN c{i} c ON v.i = c.i GROUP BY v.r, c.k)
      GROUP BY r),
    c{i + 1} AS MATERIALIZED (
      SELECT c.k, c.i, coalesce(CAST({floor} AS BIGINT), c.x) AS x
      FROM c{i} c LEFT JOIN (
        SELECT a.k, v.i, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n
        FROM a{i} a JOIN v ON a.r = v.r GROUP BY a.k, v.i) m
      ON c.k = m.k AND c.i = m.i)"""


CLUSTER_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), vec_id) - 1 AS r, embedding
  FROM embeddings
  WHERE len(embedding) = {DIMS}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT r, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM kept, range(1, {DIMS + 1}) t(i)),
c0 AS MATERIALIZED (SELECT r AS k, i, x FROM v WHERE r < {CENTROIDS}),
{",".join(_round_sql(i) for i in range(ROUNDS))},
{_round_sql(ROUNDS).split(f"c{ROUNDS + 1} AS")[0].rstrip().rstrip(",")},
digests AS (
  SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256
  FROM c{ROUNDS} GROUP BY k)
SELECT kept.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} a JOIN kept ON a.r = kept.r JOIN digests ON digests.k = a.k
"""
