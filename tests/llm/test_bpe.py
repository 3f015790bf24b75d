import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairsim.llm import bpe
from pairsim.llm.queries import REGISTRY
from pairsim.llm.vocabulary import default_path, read_json

PATH = default_path(bpe.VOCABULARY)
OURS, THEIRS = bpe.WordBpe(read_json(PATH)), Tokenizer.from_file(PATH)
SF = "/root/testdata/sf0.001"


def same(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == ids
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


LETTERS = st.sampled_from([chr(c) for c in [*range(1, 0x250), 0x3A3, 0x130, *range(0x2000, 0x2030), 0x3000, 0x301, 0x4E00, 0x1F600]])


@settings(max_examples=300, deadline=None)
@given(st.text(LETTERS, max_size=40))
def test_any_text(text):
    same(text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "\x1c", "it's They'LL", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "ΣΑΣ", "x" * 5000,
     "".join(random.Random(2).choices("abcde", k=3000)), "é ᠎​"],
)
def test_odd_text(text):
    same(text)


def test_full_cache_gives_same_ids(monkeypatch):
    small = bpe.WordBpe(read_json(PATH))
    small.cache.size = 3
    text = "the quick brown fox jumps over the lazy dog the end " * 3
    assert small.encode(text) == OURS.encode(text) and len(small.cache) <= 3


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "_PIECE", 7)
    for text in ("the quick brown fox it's " * 9, "x" * 50, "a\n" * 30 + " b", "  ", "don't  stop\t12 34 "):
        same(text)


def test_query_matches_library(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = REGISTRY["op9_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = THEIRS.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha(" ".join(map(str, ids)))
        assert r.decoded_sha256 == sha(THEIRS.decode(ids, skip_special_tokens=False))


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "a b"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("7 as ids", "*")
    got = {(r.doc_id, r.n_tokens, tuple(r.ids)) for r in bpe.encode_documents(df).collect()}
    assert got == {(1, 0, ()), (2, 0, ()), (None, 2, tuple(OURS.encode("a b")))}
    assert bpe.encode_documents(df.limit(0)).collect() == []
