import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairsim.llm import tokencount
from pairsim.llm.queries import REGISTRY
from pairsim.llm.vocabulary import default_path, read_ranks

SF = "/root/testdata/sf0.001"
PIECES = set(read_ranks(default_path(tokencount.VOCABULARY)))
LONGEST = max(map(len, PIECES))


def greedy(data, pieces=PIECES, longest=LONGEST):
    n = i = 0
    while i < len(data):
        for j in range(min(len(data), i + longest), i, -1):
            if data[i:j] in pieces:
                break
        else:
            return None
        n, i = n + 1, j
    return n


def plain(text):
    words = (text or "").encode().split()
    return len(words), sum(greedy(b" " + w) or 1 for w in words)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 for x in b)), max_size=12),
       st.binary(max_size=30).map(lambda b: bytes(x % 4 for x in b)))
def test_small_vocabularies(pieces, data):
    found = tokencount.LongestMatch(pieces).count(data)
    assert found == greedy(data, pieces, 5)


def test_query_matches_greedy(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = REGISTRY["op1_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    assert all((r.n_words, r.n_tokens) == plain(texts[r.doc_id]) for r in rows)


@pytest.mark.parametrize("text", [None, "", " \n", "a", "zzzzqqqq" * 400, "日本語 text\x0bx", "€" * 99])
def test_odd_texts(text):
    counts = tokencount.WordCounts(tokencount.LongestMatch(PIECES), size=2)
    assert counts.of_text(text) == plain(text)


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "a b"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("7 as n_tokens", "*")
    got = [tuple(r) for r in tokencount.token_counts(df).collect()]
    assert sorted(got, key=str) == [(1, 0, 0), (1, 0, 0), (2, 0, 0), (None, 2, 2)]
    assert tokencount.token_counts(df.limit(0)).collect() == []
