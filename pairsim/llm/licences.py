"""Licence scan: identifier tags and notice phrases, and the expressions they state.

One Aho-Corasick automaton over the words of a text finds, in a single pass,

- base phrases and further names of licences,
- identifier tags (``SPDX-License-Identifier``), whose expression is then read from the
  rest of the text's line,
- notice phrases (``licensed under`` and the like), whose expression is then read from
  the words that follow, as far as these are names, identifiers, ``and``, ``or``,
  ``with`` or words that notices put between them (``the``, ``version`` ...).

A shunting-yard parser turns an expression into postfix order (``with`` binds closest,
then ``and``, then ``or``; parentheses in tags) and evaluates it: the licences it
names, its canonical text, and the obligations left. With ``or`` the reader may choose, so the
milder side counts; with ``and`` the stricter one; ``with`` adds an exception, which
makes strong copyleft a weak one. An expression ends before the first word that cannot
go on, so prose after a notice is left alone.

Words are runs of letters and digits, A-Z lower-cased, any other character beyond ASCII
included; phrases match whatever stands between their words. Short identifiers such as ``mit``
count inside expressions only, as they are ordinary words elsewhere.

Each text is one pass in one task over its bytes; only the text itself, its words joined by
spaces, and its matches are held. No row depends on another, so there is no shuffle.

Defined results: a null text counts as empty; without words or matches the counts are
0, places null, labels empty strings and score 0.0; rows that repeat or share a
``doc_id``, null ids included, are scanned each; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further names of licences, as words.
NAMES = {
    "gnu general public licence": "gpl",
    "gnu gpl": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu lgpl": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu agpl": "agpl",
    "gnu free documentation license": "gfdl",
    "apache licence": "apache",
    "apache software license": "apache",
    "mit licence": "mit",
    "bsd license": "bsd",
    "bsd licence": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "the unlicense": "unlicense",
}
#: Identifiers inside an expression, without version and suffix.
IDENTIFIERS = {
    "gpl": "gpl",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "gfdl": "gfdl",
    "apache": "apache",
    "mit": "mit",
    "bsd": "bsd",
    "isc": "isc",
    "mpl": "mpl",
    "epl": "epl",
    "bsl": "bsl",
    "cc0": "cc0",
    "unlicense": "unlicense",
    "zlib": "zlib",
}
TAGS = ("spdx license identifier", "spdx license expression")
NOTICES = (
    "licensed under",
    "licenced under",
    "released under",
    "distributed under",
    "available under",
    "under the terms of",
)
#: Words that a notice may put beside names; other short numbers are versions.
FILLERS = frozenset(
    "the a an either both terms of version v license licence licenses only any later newer your choice".split()
)
#: What a licence asks: nothing, a notice, sharing of changed files, of the whole work, or no free use.
DEDICATED, PERMISSIVE, WEAK, STRONG, RESTRICTED = range(5)
OBLIGATIONS = {
    "cc0": DEDICATED,
    "unlicense": DEDICATED,
    "lgpl": WEAK,
    "mpl": WEAK,
    "epl": WEAK,
    "gpl": STRONG,
    "agpl": STRONG,
    "gfdl": STRONG,
    "cc-by-sa": STRONG,
    "cc-by-nc": RESTRICTED,
    "cc-by-nd": RESTRICTED,
    "cc-by-nc-sa": RESTRICTED,
    "cc-by-nc-nd": RESTRICTED,
}
#: How sure a statement is, by its kind.
SCORES = {"name": 0.5, "unknown": 0.7, "notice": 0.9, "tag": 1.0}
BINDS = {"or": 1, "and": 2, "with": 3}

_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_TAG = re.compile(rb"spdx[\x00-\x2f\x3a-\x60\x7b-\x7f]+license[\x00-\x2f\x3a-\x60\x7b-\x7f]+(?:identifier|expression)(?![0-9a-z\x80-\xff])", re.I)
_BEFORE = re.compile(rb"(?<![0-9A-Za-z\x80-\xff])$")
#: Nothing in a token or before it leaves the line.
_TOKEN = re.compile(rb"[ \t:=\"'`]*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_VERSION = re.compile(r"v?[0-9]{1,2}")


def identifier_label(name: str) -> tuple[str, bool]:
    """Label of an identifier such as ``GPL-2.0-only``, and whether it is known."""
    low = name.lower().rstrip(".")
    parts = low.rstrip("+").split("-")
    if parts[0] == "cc" and len(parts) > 1:
        kinds = [p for p in parts[1:] if p in ("by", "nc", "nd", "sa")]
        label = "-".join(["cc", *kinds])
        return (label, True) if "by" in kinds else (low, False)
    family = re.sub(r"v?[0-9.]+$", "", parts[0]) if parts[0] != "cc0" else "cc0"
    return (IDENTIFIERS[family], True) if family in IDENTIFIERS else (low, False)


def postfix(tokens: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Shunting-yard: operands and operators of the longest expression that ``tokens`` begin with.

    Tokens are ``(kind, text)`` with kind ``id``, ``op``, ``(`` or ``)``. An operator or
    parenthesis that is left open at the end is dropped.
    """
    out: list[tuple[str, str]] = []
    held: list[tuple[str, str]] = []
    operand_next = True
    for kind, text in tokens:
        if operand_next and kind == "(":
            held.append((kind, text))
        elif operand_next and kind == "id":
            out.append((kind, text))
            operand_next = False
        elif not operand_next and kind == "op":
            while held and held[-1][0] == "op" and BINDS[held[-1][1]] >= BINDS[text]:
                out.append(held.pop())
            held.append((kind, text))
            operand_next = True
        elif not operand_next and kind == ")" and ("(", "(") in held:
            while held[-1][0] != "(":
                out.append(held.pop())
            held.pop()
        else:
            break
    if operand_next:
        # Whatever still waits for its right side goes: opened since, or the last operator.
        while held and held[-1][0] == "(":
            held.pop()
        if held:
            held.pop()
    out += [h for h in reversed(held) if h[0] == "op"]
    return out


def _written(node) -> tuple[str, frozenset[str]]:
    """Text and labels of an expression tree; an exception's name is no label."""
    out, labels, left = [], set(), [(node, True)]
    while left:
        part, counts = left.pop()
        if isinstance(part, str):
            out.append(part)
            if counts:
                labels.add(part)
        elif part[0] == "with":
            left += [(part[2], False), (" with ", False), (part[1], counts)]
        else:
            left += [(")", False), (part[2], counts), (f" {part[0]} ", False), (part[1], counts), ("(", False)]
    return "".join(out), frozenset(labels)


def evaluate(steps: list[tuple[str, str]]) -> tuple[str, frozenset[str], int, bool] | None:
    """``(text, labels, obligation, all known)`` of a postfix expression."""
    stack: list[tuple] = []
    for kind, text in steps:
        if kind == "id":
            label, known = (text, True) if text in _LABELS else identifier_label(text)
            stack.append((label, OBLIGATIONS.get(label, PERMISSIVE), known))
            continue
        right, left = stack.pop(), stack.pop()
        node = (text, left[0], right[0])
        if text == "with":
            stack.append((node, WEAK if left[1] == STRONG else left[1], left[2]))
        else:
            level = min(left[1], right[1]) if text == "or" else max(left[1], right[1])
            stack.append((node, level, left[2] and right[2]))
    return (*_written(stack[-1][0]), *stack[-1][1:]) if stack else None


_LABELS = frozenset([*BASE.values(), *NAMES.values(), *IDENTIFIERS.values()])


def tag_tokens(text: bytes, at: int = 0) -> Iterator[tuple[str, str]]:
    """Tokens of the expression that the rest of a tag's line, from ``at`` on, begins with."""
    while found := _TOKEN.match(text, at):
        word, at = found.group(1).decode(), found.end()
        low = word.lower()
        yield (word, word) if word in "()" else ("op", low) if low in BINDS else ("id", word)


class Scanner:
    """The automaton over words, and the reading of what it finds."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        kinds = [("name", {**NAMES, **BASE}), ("tag", dict.fromkeys(TAGS)), ("notice", dict.fromkeys(NOTICES))]
        for kind, phrases in kinds:
            for phrase, label in phrases.items():
                # Latin-1 stands for bytes here; all phrases are ASCII.
                value = (kind, len(phrase.split()), label, phrase in BASE)
                self.automaton.add_word(f" {phrase} ", value)
        self.automaton.make_automaton()

    def notice_tokens(self, words: str, at: int, word: int, names: dict) -> Iterator[tuple[str, str]]:
        """Tokens from the words that start at ``at``, the ``word``-th, as far as they fit a notice."""
        skip, last = 0, None
        while at < len(words):
            end = words.find(" ", at)
            text, token = words[at:end], None
            if skip:
                skip -= 1
            elif word in names:
                n, label = names[word]
                token = ("id", label)
                skip = n - 1
            elif text in BINDS:
                follows = words[end + 1 : words.find(" ", end + 1)]
                if not (text == "or" and follows in ("later", "newer", "any")):
                    token = ("op", text)
            elif text not in FILLERS and not _VERSION.fullmatch(text):
                # An exception's name may follow a "with"; else a known identifier.
                label, known = identifier_label(text)
                if not known and last != ("op", "with"):
                    return
                token = ("id", label if known else text)
            if token:
                yield token
                last = token
            at, word = end + 1, word + 1

    def scan(self, text: bytes) -> tuple:
        """``(n_words, n_base, first, last, base_labels, labels, score, n_tags, n_notices, expressions, obligation)``."""
        joined = b" " + text.translate(_BYTES).strip() + b" "
        while b"  " in joined:
            joined = joined.replace(b"  ", b" ")
        n_words = joined.count(b" ") - 1
        if n_words < 1:
            return 0, 0, None, None, "", "", 0.0, 0, 0, [], None
        words = joined.decode("latin-1")
        at = word = n_base = n_tags = 0
        first = last = None
        base, labels, names, notices = set(), set(), {}, []
        for end, (kind, n, label, is_base) in self.automaton.iter(words):
            # Matches come by their end, so the words before are counted once.
            word += words.count(" ", at, end)
            at = end
            start = word - n
            if kind == "name":
                labels.add(label)
                if n > names.get(start, (0,))[0]:
                    names[start] = (n, label)
                if is_base:
                    base.add(label)
                    n_base += 1
                    first = start if first is None else min(first, start)
                    last = start if last is None else max(last, start)
            elif kind == "tag":
                n_tags += 1
            else:
                notices.append((end + 1, word))
        score = SCORES["name"] if labels else 0.0
        levels = [OBLIGATIONS.get(x, PERMISSIVE) for x in labels]
        expressions = []
        stated = [("notice", self.notice_tokens(words, a, w, names)) for a, w in notices]
        if n_tags:
            stated += [("tag", tokens) for tokens in self._tagged(text)]
        evaluated = []
        for kind, tokens in stated:
            found = evaluate(postfix(tokens))
            if found is not None and (found[3] or kind == "tag"):
                evaluated.append(found)
                expressions.append(found[0])
                labels |= found[1]
                score = max(score, SCORES[kind if found[3] else "unknown"])
        # A statement says what names alone leave open: which of several may be chosen.
        levels = [found[2] for found in evaluated] or levels
        return (
            n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score,
            n_tags, len(notices), sorted(set(expressions)), max(levels) if levels else None,
        )

    @staticmethod
    def _tagged(text: bytes):
        for found in _TAG.finditer(text):
            if _BEFORE.search(text[max(0, found.start() - 1) : found.start()]):
                yield tag_tokens(text, found.end())


_FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("n_tags", pa.int64()),
        ("n_notices", pa.int64()),
        ("expressions", pa.list_(pa.string())),
        ("obligation", pa.int32()),
    ]
)
#: Texts that are held in Python at a time.
_ROWS = 200


def _scan_batches(batches):
    scanner = Scanner()
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            texts = part.column(1).cast(pa.binary())
            rows = [scanner.scan(t.as_py() or b"") for t in texts]
            columns = [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), list(_FIELDS)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=_FIELDS)


def scan_licences(docs: DataFrame) -> DataFrame:
    """Base places, labels, score, expressions and obligation per row of ``docs(doc_id, text)``."""
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(_scan_batches, from_arrow_schema(_FIELDS))
