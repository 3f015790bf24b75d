import zlib
from collections import Counter

import numpy as np
import pytest

from pairsim.llm import langid
from pairsim.llm.queries import REGISTRY

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    out = Counter()
    padded = f" {low} "
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and " " not in g[1:-1] and not (n == 1 and g == " "):
                out[g] += 1
    return out


def as_text(key):
    chars = []
    while key:
        chars.append(chr((key & ((1 << 21) - 1)) - 1))
        key >>= 21
    return "".join(reversed(chars)).replace("\0", " ")


@pytest.mark.parametrize("text", ["", None, "a", "Ab c", "x--y  zz\nñé9", "über die", " a", "𝒜b İx"])
@pytest.mark.parametrize("piece", [1 << 20, 1, 3])
def test_counts(monkeypatch, text, piece):
    monkeypatch.setattr(langid, "_PIECE", piece)
    if piece < 9 and text and len(text.lower()) != len(text):
        pytest.skip("lower-casing a piece is as long as the text here")
    keys, counts = langid.gram_counts(text)
    assert {as_text(int(k)): int(c) for k, c in zip(keys, counts)} == dict(plain_grams(text))
    assert np.all(np.diff(keys) > 0)


def plain_predict(tops, text):
    grams = plain_grams(text)
    if not grams:
        return "und", 0.0
    order = sorted(grams, key=lambda g: (-grams[g], [ord(c) if c != " " else 0 for c in g]))
    # Keys of shorter n-grams are smaller numbers.
    order = sorted(order, key=lambda g: (-grams[g], len(g), [ord(c) if c != " " else 0 for c in g]))
    order = order[: langid.PROFILE]
    best = None
    for lang in sorted(tops):
        place = {g: i for i, g in enumerate(tops[lang])}
        d = sum(abs(place[g] - i) if g in place else langid.PROFILE for i, g in enumerate(order))
        d /= langid.PROFILE * len(order)
        if best is None or d < best[1]:
            best = (lang, d)
    return best[0], 1 - best[1]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = {r.doc_id: r for r in REGISTRY["op2_langid"](spark, SF).collect()}
    assert len(rows) == len(docs)
    right = held = 0
    sums, made = {}, Counter()
    for d in docs:
        r = rows[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.held_out and d.lang is not None:
            held, right = held + 1, right + (r.lang_pred == d.lang)
        elif not r.held_out and d.lang is not None:
            sums.setdefault(d.lang, Counter()).update(plain_grams(d.text))
            made[d.lang] += 1
    assert held > 100 and right / held > 0.97
    assert max(made.values()) <= langid.SAMPLE
    key = lambda g: (len(g), [ord(c) if c != " " else 0 for c in g])
    tops = {
        lang: sorted(c, key=lambda g: (-c[g], key(g)))[: langid.PROFILE] for lang, c in sums.items()
    }
    for d in docs[::10]:
        lang, score = plain_predict(tops, d.text)
        assert rows[d.doc_id].lang_pred == lang and rows[d.doc_id].score == pytest.approx(score)


def test_odd_rows(spark):
    rows = [(1, "der die das und", "de"), (1, "der die das und", "de"), (2, "the and of", "en"), (3, None, "en"), (None, "123 --", None), (4, "", "fr"), (5, "das und die", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "9 as score", "1 as _x")
    profiles = langid.learn(df)
    assert profiles.langs == ["de", "en"]
    got = langid.predict_languages(df, profiles)
    assert got.columns == ["doc_id", "text", "lang", "_x", "lang_pred", "score"]
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got.collect()) == [(0, "und"), (1, "de"), (1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "de")]
    empty = df.limit(0)
    assert langid.learn(empty).langs == []
    assert langid.predict_languages(empty, profiles).collect() == []
    assert {r.lang_pred for r in langid.predict_languages(df, langid.learn(empty)).collect()} == {"und"}


def test_sample_is_bounded(spark):
    df = spark.range(500).selectExpr("id as doc_id", "concat('abc ', id) as text", "'x' as lang")
    counts = {as_text(int(k)) for k in langid.learn(df, sample=5).keys}
    assert "abc" in counts
