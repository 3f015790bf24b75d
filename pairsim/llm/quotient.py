"""Counting quotient filters over packed n-grams of word ids: lossless and mergeable.

A gram of two to four ids of 32 bits is packed into one or two 64-bit numbers. These are
permuted invertibly, so the first number looks random. Its upper bits are the
quotient, kept only as the length of each quotient's run; the rest and, for more than two
words, the second number are the full remainder. So nothing is lost: a gram comes back by
inverting the permutation. Counters are one byte, longer ones are held apart.

Filters are sorted by quotient and remainder. They are cut into buckets of equal
ranges of the quotient; filters of one bucket merge by merging their sorted entries.
"""

from __future__ import annotations

import struct

import numpy as np

_BITS = np.uint64(64)
_FIRST, _SECOND = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_INVERSES = [pow(c, -1, 1 << 64) for c in (_SECOND, _FIRST)]
_ESCAPE = 255


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    return x ^ (x >> np.uint64(by))


def permute(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = _shifted(x, 32) * np.uint64(_FIRST)
    x = _shifted(x, 32) * np.uint64(_SECOND)
    return _shifted(x, 32)


def restore(x: np.ndarray) -> np.ndarray:
    """The inverse of ``permute``; a shift by half the bits is its own inverse."""
    x = _shifted(x, 32) * np.uint64(_INVERSES[0])
    x = _shifted(x, 32) * np.uint64(_INVERSES[1])
    return _shifted(x, 32)


def pack(words: list[np.ndarray]) -> list[np.ndarray]:
    """One number for two words, two for three or four; ids are 1 to 2^32 - 1."""
    w = [x.astype(np.uint64) for x in words] + [np.zeros(1, np.uint64)]
    high = (w[0] << np.uint64(32)) | w[1]
    if len(words) == 2:
        return [permute(high)]
    low = (w[2] << np.uint64(32)) | (w[3] if len(words) == 4 else np.uint64(0))
    return [permute(high ^ permute(low)), low]


def unpack(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of a gram: words one and two, and three and four (0 where absent)."""
    if len(keys) == 1:
        return restore(keys[0]), np.zeros(len(keys[0]), np.uint64)
    return restore(keys[0]) ^ permute(keys[1]), keys[1]


def order(keys: list[np.ndarray]) -> np.ndarray:
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new gram begins among sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def count(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    at = order(keys) if len(keys) > 1 else None
    keys = [np.sort(keys[0])] if at is None else [k[at] for k in keys]
    first = starts(keys)
    return [k[first] for k in keys], np.diff(np.append(first, len(keys[0]))).astype(np.uint64)


def members(keys: list[np.ndarray], known: list[np.ndarray]) -> np.ndarray:
    """Which of ``keys`` are among the sorted distinct ``known``."""
    n = len(known[0])
    at = np.searchsorted(known[0], keys[0])
    inside = np.zeros(len(at), bool)
    left = np.flatnonzero(at < n)
    while len(left):
        # Few grams agree in the first number and differ in the second: go on to the next.
        left = left[known[0][at[left]] == keys[0][left]]
        same = known[1][at[left]] == keys[1][left] if len(known) > 1 else np.ones(len(left), bool)
        inside[left[same]] = True
        left = left[~same]
        at[left] += 1
        left = left[at[left] < n]
    return inside


def _small(values: np.ndarray) -> bytes:
    """Numbers as one byte each; the long ones follow."""
    long = values[values >= _ESCAPE].astype("<u8")
    return np.minimum(values, _ESCAPE).astype(np.uint8).tobytes() + long.tobytes()


def _read_small(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    out = np.frombuffer(data[:n], np.uint8).astype(np.uint64)
    long = out == _ESCAPE
    end = n + 8 * int(long.sum())
    out[long] = np.frombuffer(data[n:end], "<u8")
    return out, data[end:]


_HEAD = struct.Struct("<BBBII")


def buckets_of(keys: list[np.ndarray], counts: np.ndarray, bucket_bits: int):
    """``(bucket, bytes)`` of the filter of sorted distinct ``keys``, cut by quotient."""
    n = len(counts)
    if not n:
        return
    # About one entry a quotient.
    bits = max(bucket_bits, n.bit_length(), 1)
    quotients = (keys[0] >> (_BITS - np.uint64(bits))).astype(np.int64)
    rest = (64 - bits + 7) // 8
    low = keys[0] & np.uint64((1 << (64 - bits)) - 1)
    low = low.astype("<u8").view(np.uint8).reshape(n, 8)[:, :rest]
    inside = bits - bucket_bits
    of = quotients >> inside
    edges = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), n)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        bucket = int(of[a])
        runs = np.bincount(quotients[a:b] - (bucket << inside), minlength=1 << inside)
        parts = [
            _HEAD.pack(bits, bucket_bits, len(keys), bucket, b - a),
            _small(runs),
            low[a:b].tobytes(),
            *[k[a:b].astype("<u8").tobytes() for k in keys[1:]],
            _small(counts[a:b]),
        ]
        yield bucket, b"".join(parts)


def read_bucket(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted keys and counts of one bucket."""
    bits, bucket_bits, numbers, bucket, n = _HEAD.unpack_from(data)
    inside, rest = bits - bucket_bits, (64 - bits + 7) // 8
    runs, left = _read_small(memoryview(data)[_HEAD.size :], 1 << inside)
    quotients = np.repeat(np.arange(1 << inside, dtype=np.uint64), runs.astype(np.int64))
    quotients += np.uint64(bucket << inside)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :rest] = np.frombuffer(left[: n * rest], np.uint8).reshape(n, rest)
    left = left[n * rest :]
    keys = [(quotients << (_BITS - np.uint64(bits))) | wide.view("<u8").ravel()]
    for _ in range(numbers - 1):
        keys.append(np.frombuffer(left[: 8 * n], "<u8").astype(np.uint64))
        left = left[8 * n :]
    counts, _ = _read_small(left, n)
    return keys, counts


def merge(filters: list[tuple[list[np.ndarray], np.ndarray]]):
    """``(keys, counts, group)``: merged filters, and the merged entry of every given one."""
    keys = [np.concatenate(k) for k in zip(*[f[0] for f in filters], strict=True)]
    counts = np.concatenate([f[1] for f in filters])
    at = order(keys)
    keys = [k[at] for k in keys]
    first = starts(keys)
    group = np.empty(len(at), np.int64)
    group[at] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
    return [k[first] for k in keys], np.add.reduceat(counts[at], first), group
