"""Text columns: cleaning, words, pair text, script filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and the pair marker.
NON_WORD = r"[^\p{L}\p{N}_ ]"
NON_HANGUL = r"[^ㄱ-ㅎㅏ-ㅣ가-힣 ]"
SEP_MARKER = "[SEP]"


def strip_symbols(text: Column) -> Column:
    """Each character that is not a letter, digit or underscore becomes one space.

    Java's ``\\w`` is ASCII only, so the class is spelled with Unicode properties.
    Spaces are left out of the matches because they would become spaces again.
    """
    return F.regexp_replace(text, NON_WORD, " ")


def clean(text: Column) -> Column:
    """Symbols to spaces, then lower case."""
    return F.lower(strip_symbols(text))


def words(text: Column) -> Column:
    """Words between single spaces, empty ones dropped."""
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def present_words(text: Column) -> Column:
    """``words``, with no words for a NULL text."""
    return words(F.coalesce(text, F.lit("")))


def join_words(ws: Column) -> Column:
    return F.array_join(ws, " ")


def resplit(ws: Column) -> Column:
    """Join and split again, so that a multi-word entry becomes several words."""
    return F.split(F.array_join(ws, " "), " ", -1)


def pair_text(first: Column, second: Column) -> Column:
    """Both sentences in one text around the marker; NULL when either is NULL."""
    return F.concat(first, F.lit(SEP_MARKER), second)


def keep_script(text: Column, drop_class: str = NON_HANGUL) -> Column:
    """Remove every character matched by ``drop_class`` (default: keep Hangul)."""
    return F.regexp_replace(text, drop_class, "")
