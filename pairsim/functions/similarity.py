"""Pair features that need one row only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairsim.functions.seeded import let
from pairsim.functions.text import words


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct items; 0 when both are empty."""

    def share(s: Column) -> Column:
        union = F.size(s.a) + F.size(s.b) - s.i
        return F.when(union > 0, s.i / union).otherwise(F.lit(0.0))

    def count(s: Column) -> Column:
        common = F.size(F.array_intersect(s.a, s.b))
        return let(F.struct(s.a.alias("a"), s.b.alias("b"), common.alias("i")), share)

    return let(F.struct(a.alias("a"), b.alias("b")), count)


def overlap(a: Column, b: Column) -> Column:
    """Shared items over the smaller of two arrays of distinct items; 0 when one is empty."""

    def share(s: Column) -> Column:
        smaller = F.least(F.size(s.a), F.size(s.b))
        common = F.size(F.array_intersect(s.a, s.b))
        return F.when(smaller > 0, common / smaller).otherwise(F.lit(0.0))

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams, in no particular order.

    Plain matches follow each other without overlap, so the text is read from each of its first
    ``n`` characters; that costs less than a lookahead at every character.
    """
    rest = [F.substring(text, k + 1, 2**31 - 1 - k) if k else text for k in range(n)]
    return F.array_distinct(
        F.concat(*[F.regexp_extract_all(r, F.lit("(?s)" + "." * n), F.lit(0)) for r in rest])
    )


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer character count; 1 for two empty texts."""
    return let(
        F.struct(
            F.least(F.length(a), F.length(b)).alias("s"),
            F.greatest(F.length(a), F.length(b)).alias("g"),
        ),
        lambda s: F.when(s.g > 0, s.s / s.g).otherwise(F.lit(1.0)),
    )


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays of equal length; NULL when a norm is zero."""

    def dot(x: Column, y: Column) -> Column:
        prod = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
