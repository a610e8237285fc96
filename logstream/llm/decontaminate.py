"""Finds benchmark passages in documents with a Wu-Manber search over words.

A window is ``WINDOW`` consecutive words of an item, or a shorter item as a whole. The search
looks at the last block of two words of each possible position. The shift table says how far
the position may move on without missing a window; at shift 0 the block selects a bucket
of windows, the prefix block narrows it, and the words are compared. Windows of each
length have tables of their own.

Windows reach the tasks in blocks of bounded size; each block is set against all rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstream.llm.common import lower_words, map_arrow, map_batches, text_or_empty

WINDOW = 10
# Windows in one block: some 100 MB of tables in a Python worker at most.
BLOCK_WINDOWS = 100_000
# Longest window text that counts as one in that bound.
UNIT_BYTES = 200

Words = tuple[bytes, ...]


class Hit(NamedTuple):
    """Words ``start`` to ``end``, the latter excluded, are a window of these items."""

    start: int
    end: int
    items: frozenset[int]


class Tables:
    """Shift table and buckets for windows of one length."""

    def __init__(self, length: int, windows: dict[Words, frozenset[int]]):
        self.length = length
        self.size = min(2, length)
        self.far = length - self.size + 1
        self.shift: dict[Words, int] = {}
        self.buckets: dict[Words, dict[Words, list[Words]]] = defaultdict(lambda: defaultdict(list))
        self.windows = windows
        for window in windows:
            for end in range(self.size, length + 1):
                block = window[end - self.size : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets[window[-self.size :]][window[: self.size]].append(window)

    def search(self, words: list[bytes]) -> Iterator[Hit]:
        length, size, far, shift = self.length, self.size, self.far, self.shift.get
        end, last = length, len(words)
        while end <= last:
            block = tuple(words[end - size : end])
            move = shift(block, far)
            if move:
                end += move
                continue
            start = end - length
            prefix = tuple(words[start : start + size])
            for window in self.buckets[block].get(prefix, ()):
                if words[start:end] == list(window):
                    yield Hit(start, end, self.windows[window])
            end += 1


def build(rows: Iterable[tuple[int, str]]) -> list[Tables]:
    """Tables by length, from items and windows (words joined by spaces)."""
    by_length: dict[int, dict[Words, set[int]]] = defaultdict(lambda: defaultdict(set))
    for item, window in rows:
        words = tuple(window.encode().split(b" "))
        by_length[len(words)][words].add(item)
    return [
        Tables(length, {window: frozenset(items) for window, items in found.items()})
        for length, found in sorted(by_length.items())
    ]


def windows_of(words: list[bytes], window: int = WINDOW) -> set[str]:
    if not words:
        return set()
    size = min(window, len(words))
    return {
        b" ".join(words[start : start + size]).decode() for start in range(len(words) - size + 1)
    }


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, window). Items without an id or without words have none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [
            (item, one)
            for item, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "text")))
            for one in sorted(windows_of(lower_words(text), window))
        ]
        items, found = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(found, pa.string())], ["item_id", "window"]
        )

    rows = benchmark.select(F.col("item_id").cast("long"), text_or_empty())
    return map_batches(
        rows.filter(F.col("item_id").isNotNull()), run, "item_id long, window string"
    ).distinct()


def pattern_blocks(
    benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS
) -> Iterator[list[tuple[int, str]]]:
    """The item windows in blocks of bounded size, one after another on the driver."""
    rows = item_windows(benchmark, window)
    units = F.ceil(F.length("window") / F.lit(UNIT_BYTES))
    total = rows.agg(F.coalesce(F.sum(units), F.lit(0)).alias("n")).first()["n"]
    # Half full on average, so that chance does not overfill one.
    count = 1 if total <= block_windows else -(-2 * total // block_windows)
    place = F.pmod(F.xxhash64("item_id", "window"), F.lit(count))
    for block in range(count):
        found = rows.filter(place == block).toArrow()
        yield list(zip(found["item_id"].to_pylist(), found["window"].to_pylist()))


def search(words: list[bytes], tables: list[Tables]) -> list[Hit]:
    """All hits of all lengths, by place."""
    return sorted((hit for one in tables for hit in one.search(words)), key=lambda hit: hit[:2])


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans, sorted, with overlapping and adjacent ones made one."""
    found: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((start, end))
    return found


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND = "n_words long, spans array<struct<start: int, `end`: int>>, items array<bigint>"


def _found_in(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    """The rows with their number of words, merged spans and items of one block."""
    patterns = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = build(patterns.value)
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column("text").to_pylist():
                words = lower_words(text)
                hits = search(words, tables)
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(h[:2] for h in hits)])
                items.append(sorted(set().union(*(h.items for h in hits))))
            names = [name for name in batch.schema.names if name != "text"]
            arrays = [batch.column(name) for name in names]
            arrays += [
                pa.array(n_words, pa.int64()),
                pa.array(spans, SPANS),
                pa.array(items, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_words", "spans", "items"])

    kept = ", ".join(f"`{n}` {kind}" for n, kind in docs.dtypes if n != "text")
    return map_arrow(docs, run, f"{kept}, {FOUND}")


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Merges what blocks found in a row, and sums it up."""
    n_hit, n_items, digests = [], [], []
    spans, items = [], []
    for places, found in zip(*(batch.column(c).to_pylist() for c in ("spans", "items"))):
        joined = merged((p["start"], p["end"]) for p in places)
        distinct = sorted(set(found))
        spans.append([{"start": a, "end": b} for a, b in joined])
        items.append(distinct)
        n_hit.append(sum(b - a for a, b in joined))
        n_items.append(len(distinct))
        text = ",".join(sorted(map(str, distinct)))
        digests.append(hashlib.sha256(text.encode()).hexdigest())
    long = pa.int64()
    arrays = [
        batch.column("doc_id"),
        batch.column("n_words"),
        pa.array(n_hit, long),
        pa.array(n_items, long),
        pa.array(digests, pa.string()),
        pa.array([n > 0 for n in n_hit], pa.bool_()),
        pa.array(spans, SPANS),
        pa.array(items, pa.list_(long)),
    ]
    return pa.RecordBatch.from_arrays(
        arrays,
        "doc_id n_words n_hit n_items items_sha256 contaminated spans items".split(),
    )


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """What of the benchmark each document holds: one row per row of ``docs``.

    doc_id, n_words, n_hit (words inside a window), n_items, items_sha256, contaminated, and
    the hit ``spans`` (in words) and ``items`` themselves. A NULL text has no words; an empty
    benchmark hits nothing; repeated documents and items count each; other columns are not read.
    """
    rows = docs.select("doc_id", text_or_empty()).withColumn("_text", F.xxhash64("text"))
    blocks = pattern_blocks(benchmark, window, block_windows)
    found = _found_in(rows, next(blocks))
    more = [_found_in(rows, block).filter(F.size("spans") > 0) for block in blocks]
    if more:
        found = _together(found, more)
    schema = (
        f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_hit long, n_items long, "
        "items_sha256 string, contaminated boolean, "
        "spans array<struct<start: int, `end`: int>>, items array<bigint>"
    )
    return map_batches(found, _digest, schema)


def _together(first: DataFrame, more: list[DataFrame]) -> DataFrame:
    """Every row of the first block's result, with what all blocks found in its text."""
    hits = first.filter(F.size("spans") > 0)
    for one in more:
        hits = hits.union(one)
    key = ["doc_id", "_text"]
    # Distinct first: a key then has one row per block, however often its text is repeated.
    joined = (
        hits.select(*key, "spans", "items")
        .distinct()
        .groupBy(*key)
        .agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.flatten(F.collect_list("items")).alias("items"),
        )
    )
    base = first.select(*key, "n_words").alias("base")
    on = F.expr("base.doc_id <=> hits.doc_id AND base._text = hits._text")
    return base.join(joined.alias("hits"), on, "left").select(
        "base.doc_id",
        "base._text",
        "n_words",
        F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, `end`: int>>)")).alias(
            "spans"
        ),
        F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"),
    )


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text holds no window. No row is shuffled."""
    for block in pattern_blocks(benchmark, window, block_windows):
        docs = _without(docs, block)
    return docs


def _without(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    patterns = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = build(patterns.value)
        for batch in batches:
            texts = (lower_words(text or "") for text in batch.column("text").to_pylist())
            clean = [not any(True for one in tables for _ in one.search(t)) for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
