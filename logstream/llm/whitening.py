"""Whitening of embeddings from the singular values of their centred rows.

Sums per dimension are exact. Each task reduces its centred rows to a triangle by QR, block by block; triangles
are stacked and reduced again, a bounded number at a time, until one is left: it has the singular values and right
vectors of all rows, without ever multiplying rows with each other. Its size is that of the vectors squared,
whatever the number of rows, and so it may come to the driver, where ``bidiagonal`` finds the directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstream.llm.bidiagonal import principal
from logstream.llm.common import map_batches, stored
from logstream.llm.vectors import matrix

# Triangles that meet in one task of the reduction.
FAN_IN = 16
# What is summed or squared stays below this as longs.
LARGEST = 1 << 62

_WHITE = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


def _sums(vector: str, width: int, fill: int):
    """Number of rows and exact sum of each dimension, one row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, np.int64)
        for batch in batches:
            rows = matrix(batch.column(vector), width, fill)
            n += len(rows)
            if len(rows) and int(np.abs(rows).max(initial=0)) * n > LARGEST:
                raise ValueError("sums of entries do not fit in a long")
            total += rows.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], ["n", "sums"])

    return run


def _triangles(vector: str, n: int, sums: np.ndarray, fill: int):
    """Each task's centred rows as one triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = np.zeros((0, len(sums)))
        for batch in batches:
            centred = _centred(matrix(batch.column(vector), len(sums), fill), n, sums)
            triangle = np.linalg.qr(np.vstack([triangle, centred]), mode="r")
        if len(triangle):
            yield pa.RecordBatch.from_arrays([pa.array([triangle.tobytes()])], ["triangle"])

    return run


def _centred(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``row - sums / n`` with one rounding, from the exact difference where that fits a long."""
    return _differences(rows, n, sums).astype(float) / n


def _differences(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * row - sums``, exact: longs, or Python's integers where these do not do."""
    largest = int(np.abs(rows).max(initial=0)) * n + int(np.abs(sums).max(initial=0))
    if largest >= LARGEST:
        rows, sums = rows.astype(object), sums.astype(object)
    return n * rows - sums


def _deviations(differences: np.ndarray) -> list[int | None]:
    """The sum of each row's squares, exact; None where it does not fit in a long."""
    largest = int(np.abs(differences).max(initial=0))
    if largest * largest * differences.shape[1] >= LARGEST:
        differences = differences.astype(object)
    found = np.square(differences).sum(axis=1)
    return [int(d) if int(d) < 1 << 63 else None for d in found]


def _reduced(triangles: DataFrame, width: int, parts: int) -> np.ndarray:
    """One triangle for all, FAN_IN at a time."""

    def merge(group: pa.Table) -> pa.Table:
        stacked = np.vstack([np.frombuffer(t, float).reshape(-1, width) for t in group["triangle"].to_pylist()])
        return pa.table({"triangle": [np.linalg.qr(stacked, mode="r").tobytes()]})

    while parts > 1:
        parts = -(-parts // FAN_IN)
        group = F.expr(f"pmod(xxhash64(triangle), {parts}L)")
        merged = triangles.groupBy(group.alias("part")).applyInArrow(merge, "triangle binary")
        triangles = stored(merged, "triangles")
    found = triangles.collect()
    return np.vstack([np.frombuffer(row["triangle"], float).reshape(-1, width) for row in found])


def fit(vectors: DataFrame, vector: str, components: int, fill: int = 0) -> dict | None:
    """Number of rows, sums, eigenvalues, directions and trace of the vectors' covariance; None without rows."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
    if not size["n"]:
        return None
    width = max(size["width"], 1)
    parts = vectors.select(vector).mapInArrow(_sums(vector, width, fill), "n long, sums array<long>")
    total = parts.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"))
    sums = np.array([row["s"] for row in total.orderBy("pos").collect()], np.int64)
    n = size["n"]
    made = vectors.select(vector).mapInArrow(_triangles(vector, n, sums, fill), "triangle binary")
    made = stored(made, "triangles")
    triangle = _reduced(made, width, made.count())
    square = np.zeros((width, width))
    square[: len(triangle)] = triangle
    values, directions = principal(square, components)
    eigenvalues = np.square(values) / n
    return {
        "n": n,
        "sums": sums,
        "eigenvalues": eigenvalues,
        "directions": directions,
        "trace": float(np.square(square).sum()) / n,
    }


def whiten(rows: DataFrame, components: int = 8, fill: int = 0) -> DataFrame:
    """Rows projected on the leading components of their covariance, each scaled to variance 1.

    ``rows`` has vec_id and x array<long>; other columns are ignored. A NULL vector or entry keeps a row out; a
    NULL vec_id does not, and rows that share an id each count. Shorter vectors are read as if they went on with
    ``fill``. Components are numbered from 1 by falling eigenvalue; there are no more than dimensions, and none of
    zero variance (all rows alike: no result). ``deviation`` is NULL where it does not fit in a long.
    Returns vec_id, component int, n, deviation, whitened, explained, identity_error.
    """
    rows = rows.filter(F.col("x").isNotNull() & ~F.exists("x", F.isnull)).select("vec_id", "x")
    model = fit(rows, "x", components, fill)
    if model is None or not len(model["eigenvalues"]):
        return rows.sparkSession.createDataFrame([], _WHITE)
    n, sums = model["n"], model["sums"]
    scaled = model["directions"] / np.sqrt(model["eigenvalues"])

    def project(batch: pa.RecordBatch) -> pa.RecordBatch:
        differences = _differences(matrix(batch.column("x"), len(sums), fill), n, sums)
        white = differences.astype(float) / n @ scaled
        columns = [
            batch.column("vec_id"),
            pa.array(_deviations(differences), pa.int64()),
            pa.array(white.tolist(), pa.list_(pa.float64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "white"])

    white = stored(map_batches(rows, project, "vec_id long, deviation long, white array<double>"), "white")
    explained = [float(e) / model["trace"] for e in model["eigenvalues"]]
    return white.select(
        "vec_id",
        "deviation",
        F.posexplode("white").alias("place", "whitened"),
    ).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.lit(explained), F.col("place") + 1).alias("explained"),
        F.lit(_identity_error(white, len(explained))).alias("identity_error"),
    )


def _identity_error(white: DataFrame, components: int) -> float:
    """How far the covariance of the whitened rows is from the identity, at most."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = white.agg(*(F.covar_pop(F.col("white")[i], F.col("white")[j]) for i, j in pairs)).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))
