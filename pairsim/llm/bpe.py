"""Byte-pair encoding and decoding of whole texts.

A word's parts lie in one contiguous array beside the ranks of adjacent pairs:
the least rank is found by scanning, its boundary deleted and the two ranks next
to it refreshed. That is fastest for the short words of prose; words of more
than ``SCAN_PARTS`` parts use a heap over the same ranks, which merges the same
pairs in the same order without the quadratic scan.

Defined results: a null text encodes like an empty one (no ids); special strings
of the vocabulary inside a text become their own ids, as the library does;
repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
import unicodedata
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from pairsim.llm.vocabulary import byte_symbols, default_path, read_json

VOCABULARY = "word_bpe_49k.json"
SCAN_PARTS = 256
#: Words kept with their ids in one generation of a Python worker's cache; there are
#: two, so the memory of a worker stays bounded.
CACHED_WORDS = 100_000
#: Rows that are held in Python at a time.
_ROWS = 200
#: Longer words are encoded each time.
CACHED_CHARS = 64
#: Characters of a text whose words are held at a time, up to the next space.
_PIECE = 1 << 20
#: White space as the Unicode property has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_NONE = 1 << 40


class _Cache(dict):
    """Values by key in two generations; the older one goes when the newer is full."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordBpe:
    """Encoder and decoder of a lower-casing BPE vocabulary with word ends."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        # A pair is one number, left * size + right; its rank leads to what it merges into.
        self.size = max(self.vocab.values(), default=0) + 1
        self.pair_rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merged.append(self.vocab[left + right])
            self.pair_rank.setdefault(self.vocab[left] * self.size + self.vocab[right], rank)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.strings = [strings.get(i, "") for i in range(max(strings, default=-1) + 1)]
        self.numbers = [str(i) for i in range(len(self.strings))]
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s) for s in symbols]
        self.last = [self.vocab.get(s + self.suffix) for s in symbols]
        self.words = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
        )
        longest = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.cache = _Cache(self.encode_word, CACHED_WORDS)

    def _scan(self, parts: list[int]) -> list[int]:
        rank_of, size, merged = self.pair_rank.get, self.size, self.merged
        ranks = [rank_of(a * size + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            part = parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(part * size + parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] * size + part, _NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        rank_of, size, n = self.pair_rank.get, self.size, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := rank_of(parts[i] * size + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            if not alive[i] or parts[i] != left:
                continue
            j = after[i]
            if j >= n or parts[j] != right:
                continue
            parts[i], alive[j] = self.merged[rank], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p, a in zip(parts, alive, strict=True) if a]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word; bytes the vocabulary lacks are left out, as it has no unknown id."""
        data = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        parts = [p for p in parts if p is not None]
        return tuple(self._scan(parts) if len(parts) <= SCAN_PARTS else self._heap(parts))

    def _plain_ids(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Lower-casing goes letter by letter, so no sigma becomes a final one.
            text = text.replace("Σ", "σ")
        text = text.lower()
        ids: list[int] = []
        start = 0
        while start < len(text):
            # No word spans a space.
            end = len(text) if len(text) - start <= _PIECE else text.find(" ", start + _PIECE)
            end = len(text) if end < 0 else end
            piece = text if not start and end == len(text) else text[start:end]
            ids.extend(chain.from_iterable(map(self.cache.__getitem__, self.words.findall(piece))))
            start = end
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.specials is None or not any(s in text for s in self.special):
            return self._plain_ids(text)
        out: list[int] = []
        for piece in self.specials.split(text):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                out += self._plain_ids(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder: its strings, joined by spaces."""
        return " ".join(map(self.strings.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def _shared(broadcast, key: str) -> WordBpe:
    """One encoder, with its cache, per Python worker."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(broadcast.value)
    return _LOADED[key]


def _over_texts(docs: DataFrame, path: str | None, fields: pa.Schema, columns) -> DataFrame:
    path = path or default_path(VOCABULARY)
    # The size of the vocabulary bounds what is sent.
    spec = docs.sparkSession.sparkContext.broadcast(read_json(path))

    def run(batches):
        bpe = _shared(spec, path)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows = [columns(bpe, text) for text in part.column(1).to_pylist()]
                made = [
                    pa.array(v, f.type)
                    for v, f in zip(zip(*rows, strict=True), list(fields)[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *made], schema=fields)

    return docs.select("doc_id", "text").mapInArrow(run, from_arrow_schema(fields))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids array<int>, decoded)`` per row of ``docs(doc_id, text)``."""
    fields = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    )

    def columns(bpe: WordBpe, text: str | None):
        ids = bpe.encode(text)
        return len(ids), ids, bpe.decode(ids)

    return _over_texts(docs, path, fields, columns)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: the same, digested in the task."""
    fields = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )

    def columns(bpe: WordBpe, text: str | None):
        ids = bpe.encode(text)
        numbers = " ".join(map(bpe.numbers.__getitem__, ids)).encode()
        decoded = bpe.decode(ids).encode("utf-8")
        return len(ids), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _over_texts(docs, path, fields, columns)
