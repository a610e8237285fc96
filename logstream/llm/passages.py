"""Passages that documents share, also with small changes: seeds, collinear chains, alignment.

Seeds are k-mers of words, thinned to the least hash in each window, so that equal runs of
SEED + WINDOW - 1 words always share one. Every seed is joined to its anchor, the smallest document
that has it, rather than to all others: matches grow with the seeds however many documents
share them. The matches of a document with an anchor are chained in order, with a cost for
gaps, through a Fenwick tree; the chains are then aligned word by word.

A passage of LEAST_SHARED words whose five-word shingles agree to 0.8 has at least two
seeds; matches that stand alone are dropped before texts are fetched.

The smallest documents with the seeds of a passage may have them by chance, each apart, and then
nothing is reported between these seeds' other holders. So around seeds that no reported passage
holds, in all documents that have them, every LONG words become a seed, with an anchor of
its own. Such an anchor shares LONG words, which is a piece. Equal runs of LONG words or more are
therefore covered whole, whatever the anchors are, and those next to each other make one passage: one
that agrees to 0.8 with changes spread evenly is found. Matches still grow with the seeds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logstream.llm.common import lower_white_words, map_batches, stored, text_or_empty
from logstream.llm.near_dedup import SHINGLE as SEED
from logstream.llm.near_dedup import shingle_hashes

WINDOW = 12
LEAST_SHARED = 50
# Aligned words that a reported passage has; changed words at its ends are not aligned.
LEAST_ALIGNED = 40
LEAST_SIMILAR = 0.8
# Chaining: words that a seed is worth, and the cost of each word between two.
SEED_WORTH = 5.0
GAP_COST = 0.2
# Alignment: words without a match that end a piece, and the shortest piece.
WIDEST_GAP = 16
LEAST_PIECE = 10
# Words to each side of a chain that its alignment may use.
SLACK = 64
# Words of the seeds around what the others leave out: a piece, and a multiple of SEED.
LONG = LEAST_PIECE
# Words to each side of a shared seed that an equal run may have without another one.
EDGE = WINDOW - 1
# Pieces from different anchors this near are one passage.
NEAR = 4


LONG_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def minimizers(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places whose hash is the least of some ``window`` neighbours that hold them."""
    if len(hashes) <= window:
        return np.flatnonzero(hashes == hashes.min()) if len(hashes) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    least = views.min(axis=1)
    edge = np.zeros(window - 1, np.uint64)
    around = np.concatenate((edge, least, edge))
    best = np.lib.stride_tricks.sliding_window_view(around, window).max(axis=1)
    return np.flatnonzero(best == hashes)


def seeds(docs: DataFrame) -> DataFrame:
    """doc, seed, place, and whether it is the seed's first place in the document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[list] = [[], [], [], []]
        ids = batch.column("doc_id").to_pylist()
        for doc, hashes in zip(ids, shingle_hashes(batch.column("text").to_pylist())):
            # Shorter documents hold no passage.
            if len(hashes) + SEED - 1 < LEAST_ALIGNED:
                continue
            places = minimizers(hashes)
            values = hashes[places]
            first = np.zeros(len(values), bool)
            first[np.unique(values, return_index=True)[1]] = True
            found[0].append(np.full(len(values), doc, np.int64))
            found[1].append(values.view(np.int64))
            found[2].append(places.astype(np.int32))
            found[3].append(first)
        kinds = [np.int64, np.int64, np.int32, bool]
        arrays = [pa.array(np.concatenate([np.empty(0, k), *f])) for f, k in zip(found, kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["doc", "seed", "place", "first"])

    return map_batches(docs, run, "doc long, seed long, place int, first boolean")


def long_seeds(texts: DataFrame, around: DataFrame, known: DataFrame) -> DataFrame:
    """doc, seed, place, first, and whether a known passage of the document holds it.

    The seeds are all runs of LONG words near the places in ``around``.
    """
    near = around.groupBy("doc").agg(F.collect_set("place").alias("near"))
    spans = known.groupBy("doc").agg(F.collect_list(F.array("passage_start", "passage_end")).alias("spans"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[list] = [[], [], [], [], []]
        columns = (batch.column(c).to_pylist() for c in ("doc", "near", "spans"))
        hashed = shingle_hashes(batch.column("text").to_pylist())
        for doc, near, spans, hashes in zip(*columns, hashed):
            size = len(hashes) - LONG + SEED
            if size <= 0:
                continue
            values = np.zeros(size, np.uint64)
            for offset in range(0, LONG, SEED):
                values = values * LONG_FACTOR + hashes[offset : offset + size]
            wanted, held = np.zeros(size, bool), np.zeros(size, bool)
            for place in near:
                wanted[max(0, place - EDGE - LONG + 1) : place + SEED + EDGE] = True
            for start, end in spans or ():
                held[start : max(start, end - LONG + 1)] = True
            places = np.flatnonzero(wanted)
            values = values[places]
            first = np.zeros(len(values), bool)
            first[np.unique(values, return_index=True)[1]] = True
            found[0].append(np.full(len(values), doc, np.int64))
            found[1].append(values.view(np.int64))
            found[2].append(places.astype(np.int32))
            found[3].append(first)
            found[4].append(held[places])
        kinds = [np.int64, np.int64, np.int32, bool, bool]
        arrays = [pa.array(np.concatenate([np.empty(0, k), *f]).astype(k)) for f, k in zip(found, kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["doc", "seed", "place", "first", "held"])

    return map_batches(
        texts.join(near, "doc").join(spans, "doc", "left"),
        run,
        "doc long, seed long, place int, first boolean, held boolean",
    )


def matches(seeded: DataFrame, of: str = "true") -> DataFrame:
    """doc, anchor, place, anchor_place: each seed of a document with its anchor.

    ``of`` says for which seeds; all may give an anchor.
    """
    # Stored, so that adaptive execution can split the join where a seed is very common.
    anchors = stored(
        seeded.filter("first")
        .groupBy("seed")
        .agg(
            F.min("doc").alias("anchor"),
            F.max("doc").alias("last"),
            F.min_by("place", "doc").alias("anchor_place"),
        )
        .filter("anchor <> last")
        .drop("last"),
        "anchors",
    )
    return (
        seeded.filter(of)
        .join(anchors, "seed")
        .filter("doc <> anchor")
        .select("doc", "anchor", "place", "anchor_place")
    )


def left_out(chain_rows: DataFrame, known: DataFrame) -> DataFrame:
    """doc and place of the seeds that some document has outside its known passages, or near
    the end of one, in all documents that have them."""
    at = F.explode(F.arrays_zip("places", "anchor_places"))
    held = chain_rows.select("doc", "anchor", at.alias("at")).select(
        "doc", "anchor", F.col("at.places").alias("place"), F.col("at.anchor_places").alias("anchor_place")
    )
    inside = (
        (F.col("doc") == F.col("in_doc"))
        & (F.greatest(F.col("place") - EDGE, F.lit(0)) >= F.col("passage_start"))
        & (F.col("place") + SEED + EDGE <= F.col("passage_end"))
    )
    # An anchor and its place stand for the seed.
    wanted = (
        held.join(known.withColumnRenamed("doc", "in_doc"), inside, "left_anti")
        .select("anchor", "anchor_place")
        .distinct()
    )
    return held.join(wanted, ["anchor", "anchor_place"], "left_semi").select("doc", "place")


class _Fenwick:
    """Greatest value, and its index, over prefixes of ranks."""

    def __init__(self, size: int):
        self.tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def put(self, rank: int, value: float, index: int) -> None:
        rank += 1
        while rank < len(self.tree):
            if value > self.tree[rank][0]:
                self.tree[rank] = (value, index)
            rank += rank & -rank

    def best(self, rank: int) -> tuple[float, int]:
        """Over ranks below ``rank``."""
        found = (float("-inf"), -1)
        while rank:
            if self.tree[rank][0] > found[0]:
                found = self.tree[rank]
            rank -= rank & -rank
        return found


def chains(places: list[int], others: list[int]) -> list[list[int]]:
    """Best chains of matches, each a list of indices; matches are sorted by both places.

    A chain rises in both places. Its score is the seeds' worth less the cost of the words
    between them; that cost is a difference of sums, so that the best predecessor is a
    greatest value over a prefix.
    """
    steps = np.diff(places), np.diff(others)
    if len(places) and np.array_equal(*steps) and (steps[0] * 2 * GAP_COST < SEED_WORTH).all():
        return [list(range(len(places)))]
    ranks = {value: rank for rank, value in enumerate(sorted(set(others)))}
    tree = _Fenwick(len(ranks))
    scores, before = [0.0] * len(places), [-1] * len(places)
    start = 0
    while start < len(places):
        # Matches of one place may not follow each other.
        end = start
        while end < len(places) and places[end] == places[start]:
            at = GAP_COST * (places[end] + others[end])
            value, index = tree.best(ranks[others[end]])
            gain = value - at
            scores[end], before[end] = (SEED_WORTH + gain, index) if gain > 0 else (SEED_WORTH, -1)
            end += 1
        for index in range(start, end):
            at = GAP_COST * (places[index] + others[index])
            tree.put(ranks[others[index]], scores[index] + at, index)
        start = end
    used = [False] * len(places)
    found = []
    for index in sorted(range(len(places)), key=scores.__getitem__, reverse=True):
        chain = []
        while index >= 0 and not used[index]:
            used[index] = True
            chain.append(index)
            index = before[index]
        if chain:
            found.append(chain[::-1])
    return found


CHAINS = (
    "doc long, anchor long, places array<int>, anchor_places array<int>, lengths array<int>"
)
CHAIN_NAMES = [field.split()[0] for field in CHAINS.split(", ")]


def _chain_document(doc: int, rows: list[tuple[int, int, int]], lone: bool) -> Iterator[tuple]:
    """One row per anchor: its chains, one after another, and their lengths.

    Matches that stand alone are left out unless ``lone`` is set.
    """
    places = sorted(row[1] for row in rows)
    near = []
    for row in rows:
        index = bisect_left(places, row[1])
        # Another match of the document within a passage's length, whatever its anchor.
        alone = (index + 1 >= len(places) or places[index + 1] - row[1] > LEAST_SHARED) and (
            index == 0 or row[1] - places[index - 1] > LEAST_SHARED
        )
        if lone or not alone:
            near.append(row)
    start = 0
    while start < len(near):
        end, anchor = start, near[start][0]
        while end < len(near) and near[end][0] == anchor:
            end += 1
        own = [row[1] for row in near[start:end]]
        others = [row[2] for row in near[start:end]]
        found = chains(own, others)
        flat = [index for chain in found for index in chain]
        yield (
            doc,
            anchor,
            [own[i] for i in flat],
            [others[i] for i in flat],
            [len(chain) for chain in found],
        )
        start = end


def chained(matched: DataFrame, lone: bool = False) -> DataFrame:
    """The chains of each document and anchor, in CHAINS."""
    kinds = [pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * 3

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(arrays, CHAIN_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, rows, out = None, [], []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc", "anchor", "place", "anchor_place"))
            for own, *row in zip(*columns):
                if own != doc:
                    if rows:
                        out += _chain_document(doc, rows, lone)
                    doc, rows = own, []
                    if len(out) >= 1000:
                        yield batch_of(out)
                        out = []
                rows.append(row)
        if rows:
            out += _chain_document(doc, rows, lone)
        if out:
            yield batch_of(out)

    ordered = matched.repartition("doc").sortWithinPartitions(
        "doc", "anchor", "place", "anchor_place"
    )
    return ordered.mapInArrow(run, CHAINS)


class Piece(NamedTuple):
    """Aligned words of a document and its anchor, ends excluded, and how many are equal."""

    start: int
    end: int
    anchor_start: int
    anchor_end: int
    matched: int


def _runs(
    a: list, b: list, chain: list[tuple[int, int]]
) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Equal runs (start in a, start in b, length) that the chain's seeds extend to, and
    the seeds beyond them in a whose words in b are in use."""
    runs: list[tuple[int, int, int]] = []
    missed = []
    end_a = end_b = 0
    for i, j in chain:
        if i < end_a or j < end_b:
            if i >= end_a:
                missed.append((i, j))
            continue
        while i > end_a and j > end_b and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        length = 0
        while i + length < len(a) and j + length < len(b) and a[i + length] == b[j + length]:
            length += 1
        if length:
            runs.append((i, j, length))
            end_a, end_b = i + length, j + length
    return runs, missed


def _common(a: list, b: list) -> int:
    """Length of the longest common subsequence of two short lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for place, y in enumerate(b, 1):
            last, row[place] = row[place], last + 1 if x == y else max(row[place], row[place - 1])
    return row[-1]


SKIPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2))
AFTER_SKIP = 3


def _grown(a: list, b: list, i: int, j: int, step: int) -> tuple[int, int, int]:
    """Goes on from (i, j) over changed words that equal ones follow: new ends and equal words."""
    matched = 0

    def equal(x: int, y: int) -> bool:
        return 0 <= x < len(a) and 0 <= y < len(b) and a[x] == b[y]

    while True:
        while equal(i, j):
            i, j, matched = i + step, j + step, matched + 1
        for skip_a, skip_b in SKIPS:
            x, y = i + step * skip_a, j + step * skip_b
            if all(equal(x + step * n, y + step * n) for n in range(AFTER_SKIP)):
                i, j = x, y
                break
        else:
            return i, j, matched


def align(a: list, b: list, chain: list[tuple[int, int]]) -> list[Piece]:
    """The similar pieces of a chain: runs, the gaps between them, and what grows at the ends."""
    groups: list[list[tuple[int, int, int]]] = []
    all_runs, missed = _runs(a, b, chain)
    for run in all_runs:
        if groups:
            i, j, length = groups[-1][-1]
            if max(run[0] - i - length, run[1] - j - length) <= WIDEST_GAP:
                groups[-1].append(run)
                continue
        groups.append([run])
    pieces = []
    for runs in groups:
        matched = sum(run[2] for run in runs)
        for (i, j, length), (x, y, _) in zip(runs, runs[1:]):
            matched += _common(a[i + length : x], b[j + length : y])
        last = runs[-1]
        end, anchor_end, more = _grown(a, b, last[0] + last[2], last[1] + last[2], 1)
        start, anchor_start, less = _grown(a, b, runs[0][0] - 1, runs[0][1] - 1, -1)
        piece = Piece(start + 1, end, anchor_start + 1, anchor_end, matched + more + less)
        longest = max(piece.end - piece.start, piece.anchor_end - piece.anchor_start)
        if piece.matched >= LEAST_SIMILAR * longest:
            pieces.append(piece)
        else:
            # The runs by themselves are equal throughout.
            pieces += [Piece(i, i + n, j, j + n, n) for i, j, n in runs]
    for seed in missed:
        if not any(piece.start <= seed[0] < piece.end for piece in pieces):
            pieces += [Piece(i, i + n, j, j + n, n) for i, j, n in _runs(a, b, [seed])[0]]
    return [piece for piece in pieces if piece.end - piece.start >= LEAST_PIECE]


PIECES = (
    "doc long, anchor long, start int, `end` int, anchor_start int, anchor_end int, matched int"
)
PIECE_NAMES = ["doc", "anchor", *Piece._fields]


def cut(chain_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The chains with the document's words around all of them, SLACK to each side, and where
    these begin.

    What is equal beyond that has seeds of its own, and long ones where these have other anchors.
    Only these words travel to the anchors.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        firsts, parts, last, words = [], [], None, []
        columns = (batch.column(c).to_pylist() for c in ("doc", "text", "places"))
        for doc, text, places in zip(*columns):
            if doc != last:
                last, words = doc, lower_white_words(text)
            first = max(0, min(places) - SLACK)
            firsts.append(first)
            parts.append(b" ".join(words[first : max(places) + SEED + SLACK]).decode())
        arrays = [batch.column(name) for name in CHAIN_NAMES]
        arrays += [pa.array(firsts, pa.int32()), pa.array(parts, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, [*CHAIN_NAMES, "first", "words"])

    return map_batches(chain_rows.join(texts, "doc"), run, f"{CHAINS}, first int, words string")


def aligned(cuts: DataFrame, texts: DataFrame) -> DataFrame:
    """The pieces of all chains."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        last, b = None, []
        names = (*CHAIN_NAMES, "first", "words", "anchor_text")
        for doc, anchor, places, others, lengths, first, words, text in zip(
            *(batch.column(c).to_pylist() for c in names)
        ):
            if anchor != last:
                # Neighbouring rows often have the same anchor.
                last, b = anchor, lower_white_words(text)
            a, done = words.encode().split(), 0
            pairs = [(place - first, other) for place, other in zip(places, others)]
            pieces: set[Piece] = set()
            for length in lengths:
                pieces.update(align(a, b, pairs[done : done + length]))
                done += length
            for start, end, *rest in sorted(pieces):
                out.append((doc, anchor, start + first, end + first, *rest))
        kinds = [pa.int64()] * 2 + [pa.int32()] * 5
        columns = list(zip(*out)) if out else [()] * len(kinds)
        arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, PIECE_NAMES)

    anchors = texts.select(F.col("doc").alias("anchor"), F.col("text").alias("anchor_text"))
    return map_batches(cuts.join(anchors, "anchor"), run, PIECES)


def assembled(pieces: DataFrame) -> DataFrame:
    """The pieces with the passage that they and their neighbours make, where it is long enough."""
    by_place = Window.partitionBy("doc").orderBy("start", "end", "anchor", "anchor_start")
    reached = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col("start") <= reached + NEAR, 0).otherwise(1)
    passage = Window.partitionBy("doc", "passage")
    return (
        pieces.withColumn("apart", apart)
        .withColumn("passage", F.sum("apart").over(by_place))
        .withColumn("passage_start", F.min("start").over(passage))
        .withColumn("passage_end", F.max("end").over(passage))
        .filter(F.col("passage_end") - F.col("passage_start") >= LEAST_ALIGNED)
    )


def find(docs: DataFrame) -> DataFrame:
    """Passages that documents share with a smaller one: a row for each piece.

    doc_id, start and end (words, end excluded), other_id with its start and end, matched
    (equal words), and passage_start and passage_end: the whole passage, which may be put
    together of pieces of several other documents. Every document that has a passage of another stands in a
    row, as doc_id or as other_id.

    Words stand between white space, with A-Z in lower case. Rows without a doc_id or a text hold
    no passages; rows of one doc_id are one document and must have one text; other columns are not read.
    """
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
        .filter(F.col("doc_id").isNotNull())
    )
    chain_rows = stored(chained(matches(stored(seeds(rows), "seeds"))), "chains")
    wanted = (
        chain_rows.select(F.explode(F.array("doc", "anchor")).alias("doc")).distinct()
    )
    texts = stored(
        rows.withColumnRenamed("doc_id", "doc")
        .join(wanted, "doc", "left_semi")
        .dropDuplicates(["doc"]),
        "passage-texts",
    )
    pieces = stored(aligned(cut(chain_rows, texts), texts), "pieces")
    known = stored(
        assembled(pieces).select("doc", "passage_start", "passage_end").distinct(), "passages"
    )
    longer = stored(long_seeds(texts, left_out(chain_rows, known), known), "long-seeds")
    more_rows = stored(chained(matches(longer, "not held"), lone=True), "more-chains")
    more = aligned(cut(more_rows, texts), texts)
    return assembled(pieces.unionByName(more).distinct()).select(
        F.col("doc").alias("doc_id"),
        "start",
        "end",
        F.col("anchor").alias("other_id"),
        F.col("anchor_start").alias("other_start"),
        F.col("anchor_end").alias("other_end"),
        "matched",
        "passage_start",
        "passage_end",
    )
