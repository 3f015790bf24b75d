"""SimHash fingerprints and their near-duplicate groups by pigeonring filtering.

Two fingerprints link when they differ in at most ``MAX_BITS`` bits. The 64 bits
are cut into five segments on a ring, so a linked pair has a segment from which
every chain of l consecutive segments differs in at most l * 4 / 5 bits: none in
the first segment, at most one in the first two, two in three, three in four.
Candidates meet on the chain of two (an equal segment followed by one that
differs in at most one bit), are pruned by the longer chains, and the whole
Hamming distance decides last. No link is lost.

Defined results: a null or wordless text has fingerprint zero and links like
any other; a null ``doc_id`` takes part and never becomes a component id unless
its group has no other; repeated rows are kept, one result row for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsim.llm.components import components
from pairsim.sources.scratch import durable

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Segment widths around the ring, lowest bits first.
WIDTHS = (13, 13, 13, 13, 12)
#: Beyond so many fingerprints under one chain key, links go over common
#: neighbours instead of pairs. Only the plan differs, not the links.
HOT_KEY = 512
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_PIECE = 1 << 20


def word_runs(data: bytes, piece: int = _PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``piece`` bytes, cut at white space."""
    start = 0
    while start < len(data):
        cut = _SPACE.search(data, min(start + piece, len(data)))
        end = cut.start() if cut else len(data)
        yield data[start:end].split()
        start = end + 1


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingle hashes of a text, as an unsigned number."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    total, ones = 0, np.zeros(64, np.int64)
    rest: list[bytes] = []

    def add(joined: list[bytes]) -> None:
        nonlocal total
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(x, seed) for x in joined], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones[:] += bits.sum(axis=0, dtype=np.int64)
        total += len(joined)

    for words in word_runs(data):
        words = rest + words
        if len(words) >= shingle:
            parts = [words[i:] for i in range(shingle)]
            add([b" ".join(x) for x in zip(*parts, strict=False)])
        rest = words[-(shingle - 1) :] if len(words) >= shingle else words
    if not total:
        if not rest:
            return 0
        add([b" ".join(rest)])
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprint_batches(batches):
    for batch in batches:
        # A few texts at a time are held in Python.
        slices = (batch.column(1).slice(at, 200) for at in range(0, batch.num_rows, 200))
        fps = [fingerprint(x) for part in slices for x in part.to_pylist()]
        found = np.array(fps, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(found)],
            names=["doc_id", "text_hash", "fp"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, fp)`` per row of ``docs``; ``fp`` holds the 64 bits as a long.

    ``text_hash`` is ``xxhash64(text)``, which tells apart rows that share an id.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, text_hash long, fp long")


def _offset(i: int) -> int:
    return sum(WIDTHS[:i])


def _mask(start: int, length: int) -> int:
    """Bits of ``length`` segments from ``start`` around the ring, as a signed long."""
    bits = 0
    for j in range(start, start + length):
        i = j % len(WIDTHS)
        bits |= ((1 << WIDTHS[i]) - 1) << _offset(i)
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _segment(fp: Column, i: int) -> Column:
    i %= len(WIDTHS)
    return F.shiftrightunsigned(fp, _offset(i)).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def _chain_key(fp: Column, i: int) -> Column:
    """Start of the chain, its first segment and its second one."""
    head = F.shiftleft(_segment(fp, i), 13).bitwiseOR(_segment(fp, i + 1))
    return head.bitwiseOR(F.lit(i << 26))


def _chains_hold(start: Column, diff: Column) -> Column:
    """Whether every longer chain from ``start`` keeps its proportional budget."""
    m, by_start = len(WIDTHS), None
    for i in range(m):
        held = F.lit(True)
        for length in range(3, m + 1):
            budget = length * MAX_BITS // m
            held = held & (F.bit_count(diff.bitwiseAND(F.lit(_mask(i, length)))) <= budget)
        by_start = F.when(start == i, held) if by_start is None else by_start.when(start == i, held)
    return by_start


def _neighbours(fp: Column) -> Column:
    """All values within two bits of ``fp``."""
    one = [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    two = [a ^ b for i, a in enumerate(one) for b in one[:i]]
    flips = F.array(*[F.lit(x).cast("long") for x in [0, *one, *two]])
    return F.transform(flips, lambda x: fp.bitwiseXOR(x))


def links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints ``fp`` within ``MAX_BITS`` bits.

    Pairs within a chain key are joined one by one; where a key holds more than
    ``HOT_KEY`` fingerprints, each of them is spread to all values within two
    bits and linked to the smallest fingerprint met there. Two fingerprints
    within four bits share such a value and all that share one are within four
    bits, so the components are the same and the work stays linear.
    """
    fp, m = F.col("fp"), len(WIDTHS)
    index = distinct.select(
        "fp", F.explode(F.array(*[_chain_key(fp, i) for i in range(m)])).alias("key")
    )
    flips = [
        _chain_key(fp, i).bitwiseXOR(F.lit(f))
        for i in range(m)
        for f in [0, *[1 << b for b in range(WIDTHS[(i + 1) % m])]]
    ]
    probe = distinct.select(F.col("fp").alias("other"), F.explode(F.array(*flips)).alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY)
    hot = durable(sizes.select("key"))
    some_hot = not hot.isEmpty()
    if some_hot:
        cold = index.join(hot, "key", "left_anti")
    else:
        cold = index
    diff = F.col("fp").bitwiseXOR(F.col("other"))
    # Sorted and merged: Spark takes an exploded table for as small as the one it comes from, and would send it to all.
    pairs = (
        cold.join(probe.hint("merge"), "key")
        .where(F.col("fp") > F.col("other"))
        .where(_chains_hold(F.shiftright("key", 26), diff))
        .where(F.bit_count(diff) <= MAX_BITS)
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
        .distinct()
    )
    if not some_hot:
        return pairs
    dense = (
        index.join(hot, "key", "left_semi")
        .select("fp")
        .unionAll(probe.join(hot, "key", "left_semi").select(F.col("other").alias("fp")))
        .distinct()
    )
    spread = dense.select("fp", F.explode(_neighbours(fp)).alias("x"))
    least = spread.groupBy("x").agg(F.min("fp").alias("b"), F.count("*").alias("n"))
    stars = spread.join(least.where("n > 1").hint("merge"), "x").where(F.col("fp") > F.col("b"))
    return pairs.unionAll(stars.select(F.col("fp").alias("a"), "b").distinct())


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id)`` per row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` reachable over links. Exact
    copies share a fingerprint and enter the search once, however many they are.
    """
    rows = durable(fingerprints(docs))
    groups = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = durable(components(links(groups.select("fp"))).withColumnRenamed("node", "fp"))
    first = (
        roots.join(groups, "fp")
        .groupBy("root")
        .agg(F.min("first").alias("component_id"))
    )
    linked = roots.join(first, "root").select("fp", "component_id")
    named = groups.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id")
    )
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")
