"""Columns computed from message text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(lowered: Column, words: Iterable[str]) -> Column:
    """True where the lower-case text holds one of the lower-case ``words``."""
    return reduce(or_, [lowered.contains(word) for word in words])


def mentions(text: Column, words: Iterable[str]) -> Column:
    """True where ``text`` holds one of the lower-case ``words`` in any letter case.

    A byte search on the lower-cased text: more than twice as fast as a
    case-insensitive alternation, and linear in the text.
    """
    return holds(F.lower(text), words)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def space_pieces(text: Column) -> Column:
    """Pieces between single spaces: 3 for "a  b", 1 for "".

    Counts the spaces, so no array is built per row.
    """
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return spaces + 1


def length_weighted_entropy(words: Column, length: Column) -> Column:
    """log2(words) * length / 1000, and 0 for a text without words."""
    return F.when(words > 0, F.log2(words) * length / 1000).otherwise(F.lit(0.0))
