import random
import re
from collections import Counter

import numpy as np
import pytest

from pairsim.llm import collocations, quotient


def plain(rows, least, top=collocations.TOP):
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), b in found.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                if 100 * b >= 80 * found[lang, w[i : i + n]]:
                    dropped.add((lang, w[i : i + n]))
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) not in dropped:
            cuts = [(f[lang, w[:k]], f[lang, w[k:]], k) for k in range(1, len(w))]
            score, k = min((2_000_000 * a // (x + y), k) for x, y, k in cuts)
            x, y, _ = cuts[k - 1]
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), x, y))
    return [
        (lang, i + 1, p.decode(), -a, x, y, totals[lang], -s)
        for lang, v in out.items()
        for i, (s, a, p, x, y) in enumerate(sorted(v)[:top])
    ]


def check(spark, rows, least, top=collocations.TOP):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as word", "2 as shard", "3 as n")
    got = collocations.collocations(df.repartition(3), least, top)
    assert got.dtypes[:3] == [("lang", "string"), ("rank", "bigint"), ("phrase", "string")]
    assert {t for _, t in got.dtypes[3:]} == {"bigint"}
    got = [tuple(r) for r in got.collect()]
    assert sorted(got) == sorted(plain(rows, least, top))
    return got


@pytest.mark.parametrize("seed,shard", [(1, 1), (2, 200), (3, 1 << 20)])
def test_brute_force(spark, seed, shard, monkeypatch):
    # Small shards: every phrase is spread over many filters. Python workers are forked anew.
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    rng = random.Random(seed)
    words = ["a", "B", "c", "é", "É", "Zz", "\x1c", "x\x0by", "漢", "d-e", "\x00", "b"]
    gaps = [" "] * 9 + ["  ", "\t", ". ", ",", "\r\n", "?"]
    rows = [
        (rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60))))
        for _ in range(60)
    ]
    assert len(check(spark, rows, 4)) > 50
    check(spark, rows, 6, 5)


def test_odd_rows(spark):
    rows = [("en", None), ("en", ""), ("en", " ,. \t"), ("de", "x y"), (None, "p q"), ("und", "p q"), ("en", "a b " * 30_000)]
    got = check(spark, rows, 2)
    assert {r[0] for r in got} == {"en", "und"}
    # Repeated rows count each; a phrase inside an equally frequent longer one goes.
    assert [r[2] for r in check(spark, [("en", "u v w x y")] * 40, 30)] == ["u v w x", "v w x y"]
    assert check(spark, [], 2) == []


def test_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**18, 10**18 + 1, 10**18)], "a long, l long, r long")
    got = df.selectExpr("cast(cast(a as decimal(20,0)) * 2000000 div (l + r) as long) s").first().s
    assert got == 2_000_000 * 10**18 // (2 * 10**18 + 1)


@pytest.mark.parametrize("n", [2, 3, 4])
def test_quotient_filter_is_lossless_and_merges(n):
    rng = np.random.default_rng(n)
    every, filters = Counter(), []
    for size in (1, 5, 700, 20_000):
        ids = [rng.integers(1, 40, size).astype(np.uint32) for _ in range(n)]
        ids[0][0] = np.uint32((1 << 32) - 1)
        every.update(zip(*[x.tolist() for x in ids]))
        keys, counts = quotient.count(quotient.pack(ids))
        assert (np.diff(quotient.order(keys)) == 1).all()
        parts = list(quotient.buckets_of(keys, counts, 4))
        assert len({b for b, _ in parts}) == len(parts)
        read = [quotient.read_bucket(data) for _, data in parts]
        for i in range(len(keys)):
            assert (np.concatenate([r[0][i] for r in read]) == keys[i]).all()
        assert (np.concatenate([r[1] for r in read]) == counts).all()
        filters.append((keys, counts))
    keys, counts, group = quotient.merge(filters)
    high, low = quotient.unpack(keys)
    found = {}
    for h, l, c in zip(high.tolist(), low.tolist(), counts.tolist()):
        found[(h >> 32, h & 0xFFFFFFFF, l >> 32, l & 0xFFFFFFFF)[:n]] = c
    assert found == dict(every)
    end = 0
    for mine, _ in filters:
        start, end = end, end + len(mine[0])
        assert all((k[group[start:end]] == m).all() for k, m in zip(keys, mine))
    some = [k[::3] for k in keys]
    assert (quotient.members(keys, some) == (np.arange(len(counts)) % 3 == 0)).all()


def test_members_with_equal_first_numbers():
    known = [np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 4, 1], np.uint64)]
    keys = [np.array([5, 5, 5, 9, 9, 10], np.uint64), np.array([4, 3, 1, 1, 2, 1], np.uint64)]
    assert quotient.members(keys, known).tolist() == [True, False, True, True, False, False]
    assert quotient.members(keys, [k[:0] for k in known]).tolist() == [False] * 6
