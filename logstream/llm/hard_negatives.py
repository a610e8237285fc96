"""Hard negatives by the threshold algorithm over lists sorted by dimension.

The rows lie in blocks. A block holds, for each dimension, its rows sorted by their entry. For an anchor the
lists are read from the end that its own entry favours (largest first where it is positive, smallest first where
it is negative); rows met in any list are scored by random access, exactly, in integers. What no list has shown
yet scores at most the inner product of the anchor with the entries last read; once that bound lies strictly
below the k-th score inside a window, or below the window, the rest of the block cannot matter, ties included.

Each block gives its own best rows, and the best of these are the best of all: first the positives of the
anchors, which set the windows, then the negatives. Anchors are packed in chunks, and each chunk is joined with
each block by the block's number; neither side is collected or broadcast beyond Spark's own size check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstream.llm.common import stored
from logstream.llm.vectors import matrix

BLOCK_ROWS = 16_384
LEAST_BLOCKS = 16
CHUNK_ANCHORS = 512
FIRST_DEPTH = 16
# Scores stay inside a long.
LARGEST_SCORE = 1 << 62
# Sums of products below this are exact in doubles.
EXACT = 1 << 53

_BLOCKS = "block long, ids binary, labels binary, entries binary, lists binary"
_CHUNKS = (
    "chunk long, anchor_ids binary, anchor_labels binary, anchors binary, owners binary, "
    "positive_ids binary, positive_scores binary"
)
_FOUND = "anchor_id long, positive_id long, positive_score long, other_id long, score long"


class Block:
    """Rows in the order of their ids, with a list of row numbers per dimension, smallest entry first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, entries: np.ndarray, lists: np.ndarray):
        self.ids, self.labels, self.lists = ids, labels, lists
        self.entries = entries
        self.largest = int(np.abs(entries.astype(np.int64)).max(initial=0))
        self.exact = entries.astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products as longs, from doubles where these are exact."""
        bound = self.largest * int(np.abs(anchor).sum())
        if bound < EXACT:
            return (self.exact[rows] @ anchor.astype(np.float64)).astype(np.int64)
        if bound > LARGEST_SCORE:
            raise ValueError("inner products do not fit in a long")
        return self.entries[rows].astype(np.int64) @ anchor

    def best(
        self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int
    ) -> list[list[tuple[int, int]]]:
        """For each window (both ends included) the k best allowed rows as (row, score)."""
        n, (up,), (down,) = len(self.ids), np.nonzero(anchor > 0), np.nonzero(anchor < 0)
        score = np.zeros(n, np.int64)
        known, met = np.zeros(n, bool), np.zeros(n, bool)
        depth, step = 0, FIRST_DEPTH
        while True:
            # Sorted access: the next places of every list. Zero entries have no list.
            to = min(depth + step, n) if len(up) or len(down) else n
            met[self.lists[up, n - to : n - depth].ravel()] = True
            met[self.lists[down, depth:to].ravel()] = True
            if to == n:
                met[:] = True
            # Random access: exact scores of the rows that are new.
            (new,) = np.nonzero(met & ~known)
            score[new], known[new] = self.scores(new, anchor), True
            depth, step = to, step * 2
            (rows,) = np.nonzero(known & allowed)
            kept = [self._inside(rows, score, *window) for window in windows]
            if depth >= n:
                break
            bound = int(anchor[up] @ self.entries[self.lists[up, n - depth], up].astype(np.int64))
            bound += int(anchor[down] @ self.entries[self.lists[down, depth - 1], down].astype(np.int64))
            if all(
                bound < low or (len(inside) >= k and bound < self._kth(score[inside], k))
                for inside, (low, _) in zip(kept, windows)
            ):
                break
        return [self._first(inside, score, k) for inside in kept]

    @staticmethod
    def _inside(rows: np.ndarray, score: np.ndarray, low: int, high: int) -> np.ndarray:
        found = score[rows]
        return rows[(found >= low) & (found <= high)]

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> int:
        return int(np.partition(scores, len(scores) - k)[len(scores) - k])

    @staticmethod
    def _first(rows: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Highest scores first; rows are in the order of their ids, which settles ties."""
        order = np.argsort(-score[rows], kind="stable")[:k]
        return [(int(row), int(score[row])) for row in rows[order]]


def _pack_block(width: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        entries = matrix(group["x"], width)
        largest = int(np.abs(entries).max(initial=0))
        if largest >= 1 << 31:
            raise ValueError("entries do not fit in 32 bits")
        entries = entries.astype(np.int32)
        lists = np.argsort(entries, axis=0, kind="stable").T.astype(np.int32)
        packed = [
            [group["block"][0].as_py()],
            *([_bytes(group[name].to_numpy(), np.int64)] for name in ("vec_id", "label")),
            [_bytes(entries, np.int32)],
            [_bytes(lists, np.int32)],
        ]
        return pa.table(dict(zip(("block", "ids", "labels", "entries", "lists"), packed)))

    return pack


def _bytes(array: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def _pack_chunk(width: int):
    """Anchors of a chunk, once each, and one entry per positive that points to its anchor."""

    def pack(group: pa.Table) -> pa.Table:
        ids, first, owners = np.unique(group["vec_id"].to_numpy(), return_index=True, return_inverse=True)
        rows = group.take(pa.array(first))
        packed = [
            [group["chunk"][0].as_py()],
            [_bytes(ids, np.int64)],
            [_bytes(rows["label"].to_numpy(), np.int64)],
            [_bytes(matrix(rows["x"], width), np.int64)],
            [_bytes(owners, np.int64)],
            [_bytes(group["positive_id"].to_numpy(), np.int64)],
            [_bytes(group["positive_score"].to_numpy(), np.int64)],
        ]
        names = [field.split()[0] for field in _CHUNKS.split(", ")]
        return pa.table(dict(zip(names, packed)))

    return pack


def _search(width: int, k: int, percent: tuple[int, int] | None):
    """Meets each chunk of anchors with a block; ``percent`` bounds negatives, None asks for positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != number:
                    ids, labels = (np.frombuffer(row[name], np.int64) for name in ("ids", "labels"))
                    entries = np.frombuffer(row["entries"], np.int32).reshape(len(ids), width)
                    lists = np.frombuffer(row["lists"], np.int32).reshape(width, len(ids))
                    number, block = row["block"], Block(ids, labels, entries, lists)
                yield _meet(block, row, width, k, percent)

    return run


def _meet(block: Block, row: dict, width: int, k: int, percent: tuple[int, int] | None) -> pa.RecordBatch:
    owners, positives, scores = (
        np.frombuffer(row[name], np.int64) for name in ("owners", "positive_ids", "positive_scores")
    )
    anchors = np.frombuffer(row["anchors"], np.int64).reshape(-1, width)
    ids, labels = (np.frombuffer(row[name], np.int64) for name in ("anchor_ids", "anchor_labels"))
    order = np.argsort(owners, kind="stable")
    ends = np.searchsorted(owners[order], np.arange(len(ids) + 1))
    found = []
    for i, anchor in enumerate(anchors):
        mine = order[ends[i] : ends[i + 1]]
        same = block.labels == labels[i]
        if percent is None:
            allowed, windows = same & (block.ids != ids[i]), [(-LARGEST_SCORE, LARGEST_SCORE)]
        else:
            allowed = ~same
            windows = [_window(int(score), *percent) for score in scores[mine]]
        for at, kept in zip(mine, block.best(anchor, allowed, windows, k)):
            found += [(ids[i], positives[at], scores[at], block.ids[row], score) for row, score in kept]
    columns = np.array(found, np.int64).reshape(-1, 5).T
    names = [field.split()[0] for field in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """The integers s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """Of each anchor and each of its positives the hardest rows of other labels inside a score window.

    ``rows`` has vec_id long, label long and x array<long>; other columns are ignored. ``is_anchor`` is a
    condition on vec_id. Positives are an anchor's best rows of its own label. Negatives score between ``low``
    and ``high`` percent of the positive. Higher scores come first, ties by smaller vec_id.

    A NULL id, label, vector or entry keeps a row out. Of rows that share an id the smallest (label, x) counts.
    Shorter vectors are read as if they went on with zeros. An anchor without positives, and a positive whose
    window is empty (a score below zero), has no rows. Scores that do not fit in a long raise ValueError.
    Returns anchor_id, positive_id, rank int, negative_id, positive_score, negative_score.
    """
    rows = rows.filter(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("x").isNotNull()
        & ~F.exists("x", F.isnull)
    )
    first = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("first"))
    rows = stored(first.select("vec_id", "first.label", "first.x"), "mined")
    size = rows.agg(
        F.count("*").alias("rows"),
        F.count_if(is_anchor).alias("anchors"),
        F.coalesce(F.max(F.size("x")), F.lit(0)).alias("width"),
    ).first()
    width = max(size["width"], 1)
    blocks = max(-(-size["rows"] // BLOCK_ROWS), min(LEAST_BLOCKS, size["rows"]), 1)
    chunks = max(-(-size["anchors"] // CHUNK_ANCHORS), 1)

    packed = stored(
        rows.withColumn("block", F.expr(f"pmod(xxhash64(vec_id), {blocks}L)"))
        .groupBy("block")
        .applyInArrow(_pack_block(width), _BLOCKS),
        "blocks",
    )
    anchors = rows.filter(is_anchor)

    def met(anchors: DataFrame, k: int, percent: tuple[int, int] | None) -> DataFrame:
        cells = (
            anchors.withColumn("chunk", F.expr(f"pmod(xxhash64(vec_id, 1), {chunks}L)"))
            .groupBy("chunk")
            .applyInArrow(_pack_chunk(width), _CHUNKS)
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        )
        return cells.join(packed, "block").mapInArrow(_search(width, k, percent), _FOUND)

    none = F.lit(-1).cast("long")
    own = met(
        anchors.withColumns({"positive_id": none, "positive_score": none}), positives, None
    )
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    own = own.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    windows = stored(
        own.filter("score >= 0").select(
            F.col("anchor_id").alias("vec_id"),
            F.col("other_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ),
        "positives",
    )
    others = met(anchors.join(windows, "vec_id"), negatives, (low, high))
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")
    return (
        others.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= negatives)
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("other_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
