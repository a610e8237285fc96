"""Vectors of integers: from array columns to matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are numbers."""

    def finite(entry: Column) -> Column:
        size = F.abs(entry.cast("double"))
        return entry.isNotNull() & ~F.isnan(size) & (size < float("inf"))

    return F.col(vector).isNotNull() & F.forall(vector, finite)


def scaled(vector: str, factor: int, shift: int = 0) -> Column:
    """``floor(factor * entry) + shift`` of each entry, as longs."""
    return F.transform(vector, lambda entry: F.floor(entry.cast("double") * factor) + F.lit(shift).cast("long"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int, fill: int = 0) -> np.ndarray:
    """Lists of longs as the rows of a matrix; shorter lists end in ``fill``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.full((len(sizes), width), fill, np.int64)
    rows[np.arange(width) < sizes[:, None]] = entries
    return rows
