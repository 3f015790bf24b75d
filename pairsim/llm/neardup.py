"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are scaled to length one, so cosine >= c means a distance of at most
sqrt(2 - 2c). Each of ``TABLES`` tables concatenates ``PROJECTIONS`` values
floor((a.v + b) / WIDTH) of Gaussian a and uniform b. A pair at cosine 0.95 meets
in at least one table with probability 0.988, one at 0.97 with 0.9995; random
pairs meet in one with 1e-5 each. Vectors that share a bucket are compared
in double precision.

Equal vectors are one entry with a count. Only entries that share a bucket with
another carry their vector on. A bucket of more than ``BLOCK`` entries is cut into
blocks by hash, and each pair of blocks is a task's work of its own; nothing is
capped. Tasks emit one row per entry and block pair: how many links it found there
first (pairs met in an earlier table are left to that one) and its local root.

Defined results: null vectors, and those with zero length or a null, NaN or
infinite component, link with nothing, as do rows of null ``vec_id``; vectors of
different lengths never link; repeated rows are vectors of their own, so a copy
counts as a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from pairsim.llm.components import components
from pairsim.sources.scratch import durable

COSINE = 0.95
TABLES = 36
PROJECTIONS = 16
WIDTH = 2.0
SEED = 11
BLOCK = 1500
#: Pairs whose tables are compared at a time.
_PAIRS = 200_000


def _projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    a = rng.standard_normal((dim, TABLES * PROJECTIONS))
    return a, rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


_KNOWN: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def bucket_codes(unit: np.ndarray) -> np.ndarray:
    """A 64-bit code per row and table."""
    dim = unit.shape[1]
    if dim not in _KNOWN:
        if len(_KNOWN) > 8:
            _KNOWN.clear()
        _KNOWN[dim] = _projections(dim)
    a, b = _KNOWN[dim]
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
    codes = np.full((len(unit), TABLES), dim, np.int64)
    for j in range(PROJECTIONS):
        # A multiplicative hash over the cells, wrapping around.
        codes = (codes ^ cells[:, :, j]) * np.int64(-7046029254386353131)
        codes ^= codes >> np.int64(29)
    return codes


def units(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    # Scaling by the largest component first keeps the squares in range.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector can link: finite throughout and not zero."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(~bad & some, F.lit(False))


_CODES = pa.schema([("vec_id", pa.int64()), ("codes", pa.list_(pa.int64()))])


def _code_batches(batches):
    for batch in batches:
        ids, vectors = (c.to_pylist() for c in batch.columns)
        by_dim: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_dim.setdefault(len(v), []).append(i)
        for rows in by_dim.values():
            for at in range(0, len(rows), 1000):
                part = rows[at : at + 1000]
                codes = bucket_codes(units([vectors[i] for i in part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in part], pa.int64()), pa.array(codes.tolist(), _CODES.field(1).type)],
                    schema=_CODES,
                )


_FOUND = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _local_roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable over ``linked`` (symmetric) for each row."""
    root, far = ids.copy(), np.iinfo(np.int64).max
    while True:
        near = np.where(linked, root[None, :], far).min(axis=1)
        new = np.minimum(root, near)
        if np.array_equal(new, root):
            return root
        root = new


def _compare(rows: list[tuple]) -> pa.RecordBatch | None:
    """Links within one bucket, or between two blocks of it."""
    table, cosine, left, right = rows[0][0], rows[0][1], rows[0][2], rows[0][3]
    ids = np.array([r[5] for r in rows], np.int64)
    copies = np.array([r[6] for r in rows], np.int64)
    block = np.array([r[4] for r in rows])
    codes = np.array([r[7] for r in rows], np.int64)
    unit = units([r[8] for r in rows])
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    if left != right:
        linked &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(linked))
    if not len(a):
        return None
    links = np.zeros(len(ids), np.int64)
    for at in range(0, len(a), _PAIRS):
        x, y = a[at : at + _PAIRS], b[at : at + _PAIRS]
        # The first table where a pair meets counts it.
        first = (codes[x] == codes[y]).argmax(axis=1) == table
        np.add.at(links, x[first], copies[y[first]])
        np.add.at(links, y[first], copies[x[first]])
    roots = _local_roots(linked, ids)
    told = (links > 0) | (roots != ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[told]), pa.array(links[told]), pa.array(roots[told])], schema=_FOUND
    )


def _compare_batches(batches):
    """Rows come sorted by bucket and block pair; each such run is compared alone."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[0] != key:
                if len(held) > 1 and (found := _compare(held)) is not None:
                    yield found
                key, held = row[0], []
            held.append(row[1:])
    if len(held) > 1 and (found := _compare(held)) is not None:
        yield found


def link_counts(entries: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``(vec_id, links, root)`` of ``entries(vec_id, embedding, copies)``, several rows each.

    ``links`` sums to the linked rows of other entries; the pairs ``(vec_id,
    root)`` connect what is linked.
    """
    coded = durable(
        entries.select("vec_id", "embedding").mapInArrow(_code_batches, from_arrow_schema(_CODES))
    )
    placed = coded.select("vec_id", F.posexplode("codes").alias("table", "code"))
    sizes = durable(
        placed.groupBy("table", "code").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    )
    met = placed.join(sizes, ["table", "code"]).withColumn("blocks", F.ceil(F.col("n") / block))
    own = F.pmod(F.xxhash64("vec_id", "table"), F.col("blocks")).cast("int")
    met = met.withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    )
    rows = met.join(entries.join(coded, "vec_id"), "vec_id").select(
        "table",
        "code",
        F.least("block", "other").alias("left"),
        F.greatest("block", "other").alias("right"),
        "block",
        "vec_id",
        "copies",
        "codes",
        "embedding",
    )
    ordered = rows.repartition("table", "code", "left", "right").sortWithinPartitions(
        "table", "code", "left", "right"
    )
    key = F.concat_ws("/", "table", "code", "left", "right")
    return ordered.select(
        key.alias("key"), "table", F.lit(cosine).alias("cosine"), "left", "right", "block",
        "vec_id", "copies", "codes", "embedding",
    ).mapInArrow(_compare_batches, from_arrow_schema(_FOUND))


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors(vec_id, embedding)``."""
    v = F.col("embedding")
    rows = vectors.select("vec_id", "embedding").withColumn(
        "usable", usable(v) & F.col("vec_id").isNotNull()
    )
    # Minus zero equals zero, so copies are told by the sum with zero.
    plain = F.when(F.col("usable"), F.transform(v.cast("array<double>"), lambda x: x + F.lit(0.0)))
    keyed = rows.select(
        "vec_id", "usable", plain.alias("embedding"),
        F.when(F.col("usable"), F.xxhash64(plain)).alias("k1"),
        F.when(F.col("usable"), F.xxhash64(F.lit(SEED), plain)).alias("k2"),
    )
    groups = (
        keyed.where("usable")
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    )
    groups = durable(groups)
    found = durable(link_counts(groups.select("vec_id", "embedding", "copies"), cosine, block))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    named = (
        groups.select("k1", "k2", "vec_id", "copies")
        .join(links, "vec_id", "left")
        .join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "k1",
            "k2",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
            F.coalesce("root", "vec_id").alias("root"),
        )
    )
    out = keyed.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
