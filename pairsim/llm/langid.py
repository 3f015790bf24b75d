"""Language identification by rank-order n-gram profiles.

A profile is the ranked list of the most frequent letter n-grams. A document's
profile, made from its whole text, is compared with each language's by the
out-of-place distance: the sum over its n-grams of how far their ranks differ, an
n-gram the language lacks costing the full profile length.

Languages are learned from labelled rows: a bounded sample per language, taken
evenly by hash (``SAMPLE`` documents, whole texts). Everything else covers all rows.

Defined results: ``und`` with score 0 for a null text, one without a letter, and
for all where nothing was learned; ties between languages go to the smaller name;
repeated rows are judged each. Only the text enters a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_N = 3
PROFILE = 400
#: Labelled documents per language that profiles are learned from.
SAMPLE = 3000
UNKNOWN = "und"
_BITS = 21
#: Texts are read in pieces of so many characters, overlapping by an n-gram.
_PIECE = 1 << 20
#: Texts that are held in Python at a time.
_ROWS = 200
_SPACE = 0


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_LETTER: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, zero for all else."""
    if not _LETTER:
        _LETTER.append(_letters())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points.astype(np.int64)
    points[~_LETTER[0][points]] = _SPACE
    return points


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count_piece(codes: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that end in the last ``fresh`` positions of ``codes``."""
    found = []
    for n in range(1, MAX_N + 1):
        begin = max(0, len(codes) - fresh - n + 1)
        part = codes[begin:]
        if len(part) < n:
            continue
        m = len(part) - n + 1
        gram = np.zeros(m, np.int64)
        # A gram may begin or end at the edge of a word but not span it.
        inner = np.ones(m, bool)
        for j in range(n):
            here = part[j : j + m]
            gram = (gram << _BITS) | (here + 1)
            if 0 < j < n - 1 or n == 1:
                inner &= here != _SPACE
        if n == 2:
            inner &= (part[:m] != _SPACE) | (part[1:] != _SPACE)
        found.append(gram[inner])
    grams = np.sort(np.concatenate(found)) if found else np.array([], np.int64)
    if not len(grams):
        return grams, grams
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[first], np.diff(np.r_[first, len(grams)])


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram keys of a text and their counts."""
    text = text or ""
    keys, counts = np.array([], np.int64), np.array([], np.int64)
    before = np.zeros(1, np.int64)
    for start in range(0, len(text), _PIECE):
        fresh = _codes(text[start : start + _PIECE])
        if start + _PIECE >= len(text):
            fresh = np.r_[fresh, _SPACE]
        codes = np.r_[before, fresh]
        more = _count_piece(codes, len(fresh))
        if len(keys):
            keys, counts = _merge(np.r_[keys, more[0]], np.r_[counts, more[1]])
        else:
            keys, counts = more
        before = codes[-(MAX_N - 1) :]
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent keys, by count and then by key."""
    if len(keys) > size:
        least = np.partition(counts, -size)[-size]
        chosen = counts >= least
        keys, counts = keys[chosen], counts[chosen]
    return keys[np.argsort(-counts, kind="stable")][:size]


@dataclass
class Profiles:
    """Ranks of all learned n-grams: a row per language, ``PROFILE`` where absent."""

    langs: list[str]
    keys: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, tops: dict[str, list[int]]) -> Profiles:
        langs = sorted(tops)
        keys = np.unique(np.array([k for v in tops.values() for k in v], np.int64))
        ranks = np.full((len(langs), len(keys)), PROFILE, np.int64)
        for i, lang in enumerate(langs):
            ranks[i, np.searchsorted(keys, tops[lang])] = np.arange(len(tops[lang]))
        return cls(langs, keys, ranks)

    def distances(self, text: str | None) -> np.ndarray | None:
        """Mean out-of-place distance to each language in [0, 1]; None without letters."""
        grams, counts = gram_counts(text)
        if not len(grams) or not self.langs:
            return None
        grams = ranked(grams, counts)
        places = np.arange(len(grams))
        at = np.searchsorted(self.keys, grams)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == grams if len(self.keys) else np.zeros(len(grams), bool)
        theirs = np.where(known, self.ranks[:, at], PROFILE)
        apart = np.where(theirs == PROFILE, PROFILE, np.abs(theirs - places))
        return apart.sum(axis=1) / (PROFILE * len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: how near its profile is (0 to 1)."""
        apart = self.distances(text)
        if apart is None:
            return UNKNOWN, 0.0
        best = int(np.argmin(apart))
        return self.langs[best], float(1.0 - apart[best])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _count_batches(batches) -> Iterator[pa.RecordBatch]:
    """Counts per language of the task's documents, summed before they leave it."""
    held: dict[str, list] = {}
    slices = (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS))
    for part in slices:
        for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            parts = held.setdefault(lang, [])
            parts.append(gram_counts(text))
            if sum(len(k) for k, _ in parts) > 1_000_000:
                merged = _merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts[:] = [merged]
    for lang, parts in held.items():
        keys, counts = _merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)],
            names=["lang", "gram", "n"],
        )


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from ``labelled(doc_id, text, lang)``.

    The driver gets ``PROFILE`` n-grams for each language, no more.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64("doc_id").alias("draw"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    cuts = (
        rows.select("lang", "draw")
        .withColumn("place", place)
        .where(F.col("place") <= sample)
        .groupBy("lang")
        .agg(F.max("draw").alias("cut"))
    )
    # One row per language, as many as there are profiles.
    texts = rows.join(F.broadcast(cuts), "lang").where(F.col("draw") <= F.col("cut"))
    counts = (
        texts.select("lang", "text")
        .mapInArrow(_count_batches, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PROFILE)
    tops: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "rank", "gram").collect()):
        tops.setdefault(r.lang, []).append(r.gram)
    return Profiles.of(tops)


def predict_languages(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("lang_pred string, score double")
    def predict(text: pa.Array) -> pa.Array:
        langs, scores = [], []
        for at in range(0, len(text), _ROWS):
            for t in text.slice(at, _ROWS).to_pylist():
                lang, score = model.value.predict(t)
                langs.append(lang)
                scores.append(score)
        columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score"])

    # A filter on the result would otherwise be evaluated by a second call.
    predict = predict.asNondeterministic()
    return docs.select(*[F.col(f"`{c}`") for c in kept], predict(F.col("text")).alias("_found")).select(
        *[F.col(f"`{c}`") for c in kept], "_found.lang_pred", "_found.score"
    )
