"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(record: Column) -> Column:
    """The fields of a struct as columns that later filters do not take apart.

    Catalyst rewrites a filter above a projection in terms of the projection's
    inputs, so ten tests of one parsed field would parse the JSON ten times.
    The output of a generator is left whole, and a one-element array adds no rows.
    Filters on other columns still move below it.
    """
    return F.inline(F.array(record))


def pinned(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns taken from the projection below.

    The projection shares what its expressions have in common; a filter that
    was moved below it would not.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, computed_once(F.struct(*names)))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first longer form of it that no column of ``df`` has."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
