import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from pairsim.llm import sketch
from pairsim.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def plain_hash(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def words_of(text):
    low = (text or "").lower()
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def plain_sketch(text):
    words = words_of(text)
    if not words:
        return set()
    shingles = [words[i : i + 5] for i in range(max(1, len(words) - 4))]
    return {h for h in map(plain_hash, shingles) if h < sketch.BELOW}


def plain_fingerprint(text):
    return "".join(f"{h % (1 << 64):016x}" for h in sorted(plain_sketch(text)))


def plain_likeness(x, y):
    if x is None or y is None:
        return 0.0
    if x == y or not (words_of(x) or words_of(y)):
        return 1.0
    a, b = plain_sketch(x), plain_sketch(y)
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def plain(docs):
    smallest = {}
    for d, t in docs:
        if d is not None:
            smallest[d] = min(smallest.get(d, t or ""), t or "")
    order = sorted(smallest, reverse=True)
    after = {d: smallest[order[(i + 1) % len(order)]] for i, d in enumerate(order)}
    out = []
    for d, t in docs:
        t = t or ""
        half, nxt = len(t) // 2, after.get(d)
        edited = t[: len(t) - half] + (nxt or "")[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        prints = plain_fingerprint(t), plain_fingerprint(edited)
        out.append((d, len(t), sha, *prints, plain_likeness(t, edited), plain_likeness(t, nxt)))
    return out


def same(got, want):
    assert sorted([tuple(r) for r in got], key=repr) == sorted(want, key=repr)


def test_query(spark):
    docs = [tuple(d) for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = REGISTRY["op6_fingerprints"](spark, SF).collect()
    same(rows, plain(docs))
    assert {f.name: f.dataType.simpleString() for f in REGISTRY["op6_fingerprints"](spark, SF).schema} == {
        "doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string",
        "edited_fingerprint": "string", "near_edited": "double", "near_next": "double",
    }
    long = [r for r in rows if r.n_chars > 2000]
    assert all(r.near_edited > 0.3 for r in long)
    assert sum(r.near_next < r.near_edited for r in long) > 0.95 * len(long)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a"), (4, "one two three"), (4, "one two three"), (4, "Zz"), (None, "p q r s t u v w"), (None, None), (None, "p q r s t u v w"),
            (9, "é😀\tü  x\n" * 40), (7, " \n"), (-5, "w " * 500), (12, "alpha beta " * 300 + "gamma")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as fingerprint", "3 as id")
    same(sketch.sketch_edits(df).collect(), plain(docs))
    assert sketch.sketch_edits(df.limit(0)).collect() == []
    one = df.where("doc_id = 3")
    same(sketch.sketch_edits(one).collect(), plain([(3, "a")]))


@pytest.mark.parametrize("parts", [1, 7])
def test_next_ids(spark, parts):
    ids = [x * x - 50 for x in range(200)]
    df = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, n int").repartition(parts)
    got = {r.doc_id: r.next_id for r in sketch.next_ids(df.groupBy("doc_id").agg(F.max("n").alias("n"))).collect()}
    order = sorted(set(ids))
    assert got == {x: order[i - 1] for i, x in enumerate(order)}


def test_merge_and_containment(spark):
    a = " ".join(f"w{i}" for i in range(3000))
    b = " ".join(f"v{i}" for i in range(200))
    df = spark.createDataFrame([(a, b, b + " " + a)], "a string, b string, both string")
    f = {c: sketch.sketch(F.col(c)) for c in df.columns}
    row = df.select(
        sketch.likeness(f["b"], f["both"]).alias("held"),
        sketch.likeness(f["a"], f["b"]).alias("apart"),
        F.size(F.array_except(sketch.merged(f["a"], f["b"]), f["both"])).alias("lost"),
        sketch.likeness(sketch.merged(f["a"], f["b"]), f["both"]).alias("merged"),
    ).first()
    assert tuple(row) == (1.0, 0.0, 0, 1.0)


def test_error_of_containment_by_shingles(spark):
    """Half the shingles of short texts lie in a long one: the estimate's error falls with their number."""
    rows = []
    for n in (4, 16, 64, 256):
        for i in range(200):
            own = [f"s{n}x{i}y{j}" for j in range(n + 4)]
            held = own[: n // 2 + 4]
            rows.append((n, " ".join(own), " ".join(held + [f"l{i}z{j}" for j in range(3000)])))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    near = sketch.likeness(sketch.sketch(F.col("a")), sketch.sketch(F.col("b")))
    error = df.select("n", F.abs(near - 0.5).alias("e")).groupBy("n").agg(F.avg("e").alias("e")).collect()
    error = {r.n: r.e for r in error}
    print(error)
    assert error[4] > error[16] > error[64] > error[256] and error[256] < 0.06
