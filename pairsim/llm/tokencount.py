"""Token counts by greedy longest match over a vocabulary, without building pieces.

The vocabulary is a byte trie with failure links. Where a node's string cannot be
extended, the pieces a greedy matcher would have finished are popped: their number
is stored at the node together with the link to the node of what remains. Every
byte of a word is read once, so a word costs linear time however its pieces overlap.

A text is cut into words at ASCII white space; a word is matched behind a space
(``b" " + word``), which in byte-level vocabularies marks the start of a word. A
word that the vocabulary cannot cover counts as one unknown token.

Defined results: null, empty and blank texts have no words and no tokens; repeated
rows are counted each.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from pairsim.llm.simhash import word_runs
from pairsim.llm.vocabulary import default_path, read_ranks

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words kept with their counts per Python worker.
CACHED_WORDS = 200_000
CACHED_BYTES = 64


class LongestMatch:
    """Number of greedy longest-match pieces of a byte string."""

    def __init__(self, pieces: Iterable[bytes]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                at = child[node].get(byte)
                if at is None:
                    at = child[node][byte] = len(child)
                    child.append({})
                    final.append(False)
                node = at
            final[node] = node != 0
        link, popped = [-1] * len(child), [0] * len(child)
        queue = deque((0, byte, node) for byte, node in child[0].items())
        while queue:
            parent, byte, node = queue.popleft()
            if final[node]:
                # The whole string is one piece; nothing of it remains.
                link[node], popped[node] = 0, 1
            else:
                at, n = link[parent], popped[parent]
                while at >= 0 and byte not in child[at]:
                    n += popped[at]
                    at = link[at]
                if at >= 0:
                    link[node], popped[node] = child[at][byte], n
            queue.extend((node, b, c) for b, c in child[node].items())
        self.child, self.link, self.popped = child, link, popped

    def count(self, data: bytes) -> int | None:
        """Pieces of ``data``; None where greedy matching meets an uncovered byte."""
        child, link, popped = self.child, self.link, self.popped
        node = n = 0
        for byte in data:
            while (at := child[node].get(byte)) is None:
                if link[node] < 0:
                    return None
                n += popped[node]
                node = link[node]
            node = at
        while node:
            if link[node] < 0:
                return None
            n += popped[node]
            node = link[node]
        return n


class WordCounts(dict):
    """Token count by word, kept up to a bound."""

    def __init__(self, matcher: LongestMatch, size: int = CACHED_WORDS):
        super().__init__()
        self.matcher, self.size = matcher, size

    def __missing__(self, word: bytes) -> int:
        n = self.matcher.count(b" " + word)
        n = 1 if n is None else n
        if len(word) <= CACHED_BYTES:
            if len(self) >= self.size:
                self.clear()
            self[word] = n
        return n

    def of_text(self, text: str | None) -> tuple[int, int]:
        """Words and tokens of a text."""
        words = tokens = 0
        for run in word_runs((text or "").encode("utf-8", "surrogatepass")):
            words += len(run)
            tokens += sum(map(self.__getitem__, run))
        return words, tokens


_LOADED: dict[str, WordCounts] = {}


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` per row of ``docs(doc_id, text)``."""
    path = path or default_path(VOCABULARY)
    # The size of the vocabulary bounds what is sent.
    pieces = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    fields = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_tokens")])

    def run(batches):
        if path not in _LOADED:
            _LOADED.clear()
            _LOADED[path] = WordCounts(LongestMatch(pieces.value))
        counts = _LOADED[path]
        for batch in batches:
            # A few texts at a time are held in Python.
            slices = (batch.column(1).slice(at, 200) for at in range(0, batch.num_rows, 200))
            found = [counts.of_text(t) for part in slices for t in part.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([w for w, _ in found], pa.int64()),
                    pa.array([n for _, n in found], pa.int64()),
                ],
                schema=fields,
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, n_tokens long"
    )
