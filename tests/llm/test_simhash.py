import itertools
import random

import pytest
import xxhash

from pairsim.llm import simhash
from pairsim.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def plain_groups(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= bits:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


def check_whole(rows):
    fps = {int(r.fingerprint, 16) for r in rows}
    roots, least = plain_groups(fps), {}
    for r in rows:
        if r.doc_id is not None:
            k = roots[int(r.fingerprint, 16)]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    for r in rows:
        assert r.component_id == least.get(roots[int(r.fingerprint, 16)])


def test_query_matches_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = REGISTRY["op10_simhash"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert int(r.fingerprint, 16) == plain_fingerprint(texts[r.doc_id])
    check_whole(rows)


@pytest.mark.parametrize(
    "text", [None, "", " \n\t", "One", "a b c", "A b\x0bc d", "x " * 50, "é\x85ü ß q w e r t"]
)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(random.Random(3).choices(["alpha", "beta", "c", "delta"], k=3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash.word_runs, "__defaults__", (37,))
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("hot", [10_000, 20])
def test_links_and_dense_keys(spark, monkeypatch, hot):
    """Dense clusters by pairs and by common neighbours give the same components."""
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    rng, fps = random.Random(5), set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            flips = rng.sample(range(64), rng.randint(0, 5))
            fps.add(base ^ sum(1 << b for b in flips))
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    found = simhash.links(df).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 4 for r in found)
    roots = {f: f for f in fps}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for r in found:
        a, b = find(r.a & mask), find(r.b & mask)
        roots[max(a, b)] = min(a, b)
    assert {f: find(f) for f in fps} == plain_groups(fps)
    if hot == 10_000:
        pairs = {(min(a, b), max(a, b)) for a, b in itertools.combinations(fps, 2)
                 if (a ^ b).bit_count() <= 4}
        assert {tuple(sorted((r.a & mask, r.b & mask))) for r in found} == pairs


def test_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (None, "a b c d e"), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as first")
    got = simhash.simhash_groups(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (2, 2), (3, 2)]
    assert sorted([r.component_id for r in got if r.doc_id is None], key=str) == [1, None]
    assert simhash.simhash_groups(df.limit(0)).collect() == []


def test_exploded_tables_are_not_sent_to_all(spark):
    df = spark.range(40).selectExpr("id * 1234567890123 as fp")
    plan = simhash.links(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
