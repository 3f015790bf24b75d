"""Seeded draws as pure functions of (seed, key, ...).

Nothing here depends on partitioning, task order or retries: the same key
gives the same draw wherever and however often it is computed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    """A Column as is, anything else as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def draw_hash(*parts) -> Column:
    """32 hex digits that order rows at random for the given parts."""
    return F.md5(F.concat_ws("|", *[as_col(p).cast("string") for p in parts]).cast("binary"))


def extend(prefix: Column, *parts) -> Column:
    """``draw_hash`` of further parts after a text of joined parts.

    Binding the common parts of many draws once halves their cost.
    """
    pieces = [prefix]
    for p in parts:
        pieces += [F.lit("|"), as_col(p).cast("string")]
    return F.md5(F.concat(*pieces).cast("binary"))


def hash_above(digest: Column, p: float) -> Column:
    """Whether the unit draw of a digest exceeds ``p``, compared as hex digits."""
    if p >= 1 or p < 0:
        # Eight digits cannot hold these bounds.
        return F.lit(p < 0)
    return F.substring(digest, 1, 8) > F.lit(f"{int(p * 4294967296):08x}")


def hash_to_unit(digest: Column) -> Column:
    """Map the first 32 bits of a hex digest to [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def u01(*parts) -> Column:
    """Uniform draw in [0, 1) for the given parts."""
    return hash_to_unit(draw_hash(*parts))


def hash_to_index(digest: Column, size: Column) -> Column:
    """Uniform 0-based index below ``size``."""
    return F.floor(hash_to_unit(digest) * size).cast("int")


def draw_index(size: Column, *parts) -> Column:
    return hash_to_index(draw_hash(*parts), size)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    The optimizer may inline a projected column into a lambda, where it would
    be evaluated once per element; binding it to a lambda variable prevents it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
