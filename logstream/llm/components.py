"""Connected components of a graph of links, by alternating stars.

Each round first ties all larger neighbours of a node to its smallest neighbour, then all
smaller ones. What remains when nothing changes is one star around each component's
smallest node. Nodes with very many links are merged map-side and split by the join.
A graph of few links, counted, is a matter of one small task and takes no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstream.llm.common import map_arrow, stored


# Links of a graph that one task resolves, in a few MB; with more the rounds do.
FEW_LINKS = 50_000


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked with, for all but the roots.

    ``links`` has ``a`` and ``b``; their order, repetitions and loops do not matter, and
    links without one of their ends are none.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    if edges.count() <= FEW_LINKS:
        return stored(map_arrow(edges.coalesce(1), _small_graph, "node long, root long"), "roots")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state["n"] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        edges = stored(_small_star(_large_star(edges)), "links")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .filter("v > u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def _small_graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's smallest companion, by merging sets."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while parent.setdefault(node, node) != node:
            parent[node] = node = parent[parent[node]]
        return node

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            low, high = sorted((root(u), root(v)))
            parent[high] = low
    nodes = [node for node in parent if root(node) != node]
    columns = [pa.array(nodes, pa.int64()), pa.array([root(node) for node in nodes], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["node", "root"])
