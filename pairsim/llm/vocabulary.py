"""Files of public tokenizers, read on the driver and handed to the tasks."""

from __future__ import annotations

import base64
import json
from functools import lru_cache


def default_path(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def read_ranks(path: str) -> tuple[bytes, ...]:
    """Byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return tuple(base64.b64decode(a) for a, _ in sorted(pairs, key=lambda p: int(p[1])))


@lru_cache(maxsize=4)
def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]
