import random
import re

import pytest

from pairsim.llm import licences
from pairsim.llm.queries import REGISTRY

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """Words and base places, word by word."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    at, labels = [], set()
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def scan(text):
    return dict(zip([f.name for f in licences._FIELDS][1:], licences.Scanner().scan(text.encode())))


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = REGISTRY["op11_licences"](spark, SF).collect()
    assert len(got) == len(texts)
    labelled = 0
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score > 0) == (r.labels != "") and 0 <= r.score <= 1
        # Clean documents get no label: all that are labelled speak of a licence.
        if r.labels:
            labelled += 1
            assert re.search(r"licen[sc]e|cc.by|spdx|released under", texts[r.doc_id], re.I)
    assert labelled > 10


def test_random_words():
    rng = random.Random(1)
    words = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "é", "x1", "by", "cc"]
    gaps = [" ", "  ", "\n", "-", ", ", "\x00", "_", "‑"]
    scanner = licences.Scanner()
    for _ in range(2000):
        text = "".join(rng.choice(words).title() + rng.choice(gaps) for _ in range(rng.randint(0, 25)))
        assert scanner.scan(text.encode())[:5] == plain(text), text


def recursive(tokens, level=1):
    """The value of a whole expression by recursive descent."""

    def atom():
        kind, text = tokens.pop(0)
        if kind == "(":
            out = recursive(tokens)
            assert tokens.pop(0)[0] == ")"
            return out
        label, known = licences.identifier_label(text)
        return label, frozenset([label]), licences.OBLIGATIONS.get(label, licences.PERMISSIVE), known

    def step(level):
        if level > 3:
            return atom()
        out = step(level + 1)
        while tokens and licences.BINDS.get(tokens[0][1]) == level:
            _, op = tokens.pop(0)
            out = join(op, out, step(level + 1))
        return out

    return step(level)


def join(op, a, b):
    if op == "with":
        return f"{a[0]} with {b[0]}", a[1], licences.WEAK if a[2] == licences.STRONG else a[2], a[3]
    return f"({a[0]} {op} {b[0]})", a[1] | b[1], (min if op == "or" else max)(a[2], b[2]), a[3] and b[3]


def test_parser_against_recursive_descent():
    rng = random.Random(2)
    ids = ["MIT", "GPL-2.0-only", "Apache-2.0", "LGPL-3.0+", "CC-BY-NC-4.0", "CC0-1.0", "Foo-1"]

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(ids)
        inner = f"{expression(depth - 1)} {rng.choice(['AND', 'or', 'And', 'WITH'])} {expression(depth - 1)}"
        return f"({inner})" if rng.random() < 0.4 else inner

    for _ in range(1000):
        text = expression(4)
        tokens = list(licences.tag_tokens(text.encode()))
        assert licences.evaluate(licences.postfix(tokens)) == recursive(list(tokens)), text
        found = scan(f"x\n// SPDX-License-Identifier: {text}\nnext line or MIT")
        assert found["expressions"] == [recursive(list(tokens))[0]] and found["n_tags"] == 1


@pytest.mark.parametrize(
    "text,labels,score,level",
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", 0.9, licences.RESTRICTED),
        ("Licensed under the Apache License, Version 2.0.", "apache", 0.9, licences.PERMISSIVE),
        ("This work is licensed under the GNU General Public License, version 3 or later", "gpl", 0.9, licences.STRONG),
        ("licensed under either the MIT License or the GPL v2, at will", "gpl,mit", 0.9, licences.PERMISSIVE),
        ("Distributed under GPL with classpath exception", "gpl", 0.9, licences.WEAK),
        ("he was released under bail and the mit of it", "", 0.0, None),
        ("The MIT License", "mit", 0.5, licences.PERMISSIVE),
        ("SPDX-License-Identifier: (MIT OR", "mit", 1.0, licences.PERMISSIVE),
        ("SPDX-License-Identifier: Foo-Bar", "foo-bar", 0.7, licences.PERMISSIVE),
        ("SPDX-License-Identifier: ) MIT", "", 0.0, None),
        ("xSPDX-License-Identifier: MIT", "", 0.0, None),
        ("", "", 0.0, None),
    ],
)
def test_statements(text, labels, score, level):
    found = scan(text)
    assert (found["labels"], found["score"], found["obligation"]) == (labels, score, level)


def test_long_statements():
    text = "SPDX-License-Identifier: " + " or ".join(f"X{i}" for i in range(30_000)) + " SPDX-License-Identifier: MIT" * 3000
    found = scan("(" * 9 + text)
    assert found["n_tags"] == 3001 and found["labels"].count(",") == 30_000
    found = scan("licensed under " + "the mit license or " * 50_000)
    assert found["labels"] == "mit" and found["n_notices"] == 1
    nested = "SPDX-License-Identifier: " + "(" * 50_000 + "MIT" + ")" * 50_000
    assert scan(nested)["expressions"] == ["mit"]


def test_odd_rows(spark):
    long = "word " * 400_000 + "cc by " + "x" * 1_000_000 + " MIT license"
    rows = [(1, None), (1, ""), (None, "cc by cc by"), (None, "cc by cc by"), (2, long), (3, " \n\t"), (4, "漢字 mit-LICENSE")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as score", "8 as labels")
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in licences.scan_licences(df).collect()}
    assert got == {
        (1, 0, 0, None, None, ""), (None, 4, 2, 0, 2, "cc-by"), (2, 400_005, 2, 400_000, 400_003, "cc-by,mit"),
        (3, 0, 0, None, None, ""), (4, 3, 1, 1, 1, "mit"),
    }
    assert licences.scan_licences(df).count() == 7
    assert licences.scan_licences(df.limit(0)).count() == 0
