"""Near duplicates: banded MinHash, sequential Bayesian pruning, exact verification.

Documents of equal shingle sets are one class, and only its smallest document goes on.
Bands of the signatures put classes into buckets, and each bucket is given a pivot, a document
that shares buckets with most others, from among its members' bucket neighbours. Members are
compared with pivots, never all with each other. A comparison reads the signatures batch by
batch and stops as soon as the posterior probability of a similarity over the threshold falls
below the chosen miss probability. What survives is verified on the full shingle sets.

Members that are not linked with their pivot may still be linked with each other, but then they
have shingles in common that the pivot lacks, and how many at least follows from their sizes. So
they meet again by such shingles (of which all but that many, less one, are enough), name a pivot
among them, and so on; what counts then is what all pivots so far lack. In a group of up to FEW
each member is a pivot, which ends it. All ends when no group has members of two components left
that were not compared or ruled out. Only members just below the threshold are compared directly
with those of the smaller members that come into question.
Each step costs a multiple of a group's size, and none is cut off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstream.llm.common import LOWER, map_arrow, map_batches, stored, text_or_empty
from logstream.llm.components import components

SHINGLE = 5


@dataclass(frozen=True)
class Settings:
    """Similarity in percent, signature, and what may be missed.

    A pair at the threshold shares no band with probability (1 - 0.85 ** rows) ** bands, 3e-7
    for 32 bands of 6, and is pruned with about ``miss`` in each batch.
    """

    percent: int = 85
    bands: int = 32
    rows: int = 6
    batch: int = 32
    miss: float = 1e-6

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _constants(count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, count, np.uint64)


WORD_FACTORS = _constants(SHINGLE, 11) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
# Members of a group up to which each of them is a pivot.
FEW = 32
# Members of a group that meet its pivots' texts in one place.
PART = 64
# Texts that are split into words at a time: as objects, words take many times their bytes.
SOME_TEXTS = 64
# Hash values that are compared in one step; keeps the matrix in the cache.
STEP = 512


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    sets = []
    for first in range(0, len(texts), SOME_TEXTS):
        sets += map(np.unique, shingle_hashes(texts[first : first + SOME_TEXTS]))
    return sets


def shingle_hashes(texts: list[str]) -> list[np.ndarray]:
    """The hashes of each text's shingles, in order."""
    split = [text.encode().translate(LOWER).split() for text in texts]
    words = [word for one in split for word in one]
    if not words:
        return [np.empty(0, np.uint64) for _ in texts]
    codes, distinct = pd.factorize(np.array(words, object))
    hashes = pd.util.hash_array(np.asarray(distinct, object), categorize=False)[codes]
    padded = np.concatenate((hashes, np.zeros(SHINGLE, np.uint64)))
    total = np.zeros(len(hashes), np.uint64)
    for place, factor in enumerate(WORD_FACTORS):
        total += padded[place : place + len(hashes)] * factor
    found, start = [], 0
    for one in split:
        end = start + len(one)
        if len(one) >= SHINGLE:
            own = total[start : end - SHINGLE + 1]
        elif one:
            # Fewer words: the sequence as a whole, apart from any five words.
            own = (hashes[start:end] * WORD_FACTORS[: len(one)]).sum(keepdims=True) + np.uint64(len(one))
        else:
            own = total[:0]
        found.append(_mixed(own))
        start = end
    return found


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MIX
    return values ^ (values >> np.uint64(29))


def signature(shingles: np.ndarray, turns: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for first in range(0, len(short), STEP):
        values = (short[first : first + STEP, None] ^ turns) * factors
        np.minimum(least, values.min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the set) and signature, both NULL if it is empty."""
    turns = (_constants(settings.hashes, 21) >> np.uint64(32)).astype(np.uint32)
    factors = (_constants(settings.hashes, 22) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text").to_pylist())
        ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        marks = [signature(s, turns, factors).tobytes() if len(s) else None for s in sets]
        arrays = [
            batch.column("doc_id"),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(ids, pa.binary()),
            pa.array(marks, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set_id", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    return map_batches(rows, run, "doc_id long, n_shingles long, set_id binary, signature binary")


def least_matches(settings: Settings) -> list[int]:
    """By batch: the matches below which a pair is pruned.

    With a uniform prior the posterior of the similarity after m matches of n is a beta
    distribution; it lies above t with the probability that n + 1 draws of chance t give m at most.
    """
    t = settings.percent / 100
    limits = []
    for n in range(settings.batch, settings.hashes + 1, settings.batch):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= settings.miss:
                break
            m += 1
        limits.append(m)
    return limits


def survivors(pairs: DataFrame, marks: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) that no batch of their signatures rules out."""
    limits = least_matches(settings)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(
                batch.num_rows, settings.hashes
            )
            for c in ("mark_a", "mark_b")
        )
        alive = np.arange(batch.num_rows)
        matches = np.zeros(batch.num_rows, np.int64)
        for number, limit in enumerate(limits):
            some = slice(number * settings.batch, (number + 1) * settings.batch)
            matches[alive] += (left[alive, some] == right[alive, some]).sum(axis=1)
            alive = alive[matches[alive] >= limit]
        return batch.select(["a", "b"]).take(pa.array(alive))

    own = marks.select(F.col("doc_id"), "signature")
    a = own.select(F.col("doc_id").alias("a"), F.col("signature").alias("mark_a"))
    b = own.select(F.col("doc_id").alias("b"), F.col("signature").alias("mark_b"))
    return map_batches(pairs.join(b, "b").join(a, "a"), run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # A pivot's text stands in many rows.
            left = dict(zip(batch.column("a").to_pylist(), batch.column("text_a").to_pylist()))
            sets_a = dict(zip(left, shingle_sets(list(left.values()))))
            sets_b = shingle_sets(batch.column("text_b").to_pylist())
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), sets_b):
                both = len(np.intersect1d(sets_a[a], b, assume_unique=True))
                union = len(sets_a[a]) + len(b) - both
                keep.append(100 * both >= settings.percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return map_arrow(pairs.join(b, "b").join(a, "a"), run, "a long, b long")


def _buckets(marks: DataFrame, settings: Settings) -> DataFrame:
    """bucket and doc, for buckets of at least two documents."""
    width = 4 * settings.rows
    # The band's number is hashed too: equal rows of two bands are not one bucket.
    keys = [
        F.xxhash64(F.substring("signature", 1 + band * width, width), F.lit(band))
        for band in range(settings.bands)
    ]
    banded = marks.select(F.explode(F.array(*keys)).alias("bucket"), F.col("doc_id").alias("doc"))
    shared = banded.groupBy("bucket").agg(F.min("doc").alias("x"), F.max("doc").alias("y"))
    return banded.join(shared.filter("x <> y").select("bucket"), "bucket", "left_semi")


def _groups(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pivots, doc) for all buckets, a list of one pivot each; and documents' weights as pivots."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    weights = stored(
        members.join(sizes, "bucket").groupBy("doc").agg(F.sum("size").alias("weight")), "weights"
    )

    def heaviest(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.max("rank").alias("rank"))

    ranked = members.join(weights.select("doc", F.struct("weight", "doc").alias("rank")), "doc")
    # From members to buckets, on to all their members, and to buckets again.
    around = stored(heaviest(ranked, "bucket"), "leaders")
    leaders = heaviest(members.join(around, "bucket"), "doc")
    pivots = heaviest(members.join(leaders, "doc"), "bucket")
    found = members.join(pivots.select("bucket", F.array("rank.doc").alias("pivots")), "bucket")
    return found.select("pivots", "doc").distinct(), weights


TOKENS = "pivots array<long>, doc long, token long, bound long"


def _tokens(named: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Shingles that all pivots lack, as many as a link of the member needs at least one of.

    A member x shares with any y of its group that it is linked with at least
    p (|x| + least) / (100 + p) shingles, p being the threshold and ``least`` the size of the
    smallest member; those beyond what it shares with the pivots are shingles that they lack.
    Where there are none beyond, ``bound`` is the size up to which x may be linked all the same.
    """

    sizes = named.groupBy("pivots").agg(F.min("n").alias("least"), F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / PART)
    sizes = stored(sizes.select("pivots", "least", parts.cast("int").alias("parts")), "sizes")
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part")
    members = named.join(sizes, "pivots").select("pivots", part, "least", "doc")
    # The pivots' texts come once to each part, ahead of its members.
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    pivots = sizes.select("pivots", F.explode(every).alias("part"))
    none = F.lit(None).cast("long").alias("least")
    pivots = pivots.select("pivots", "part", none, F.explode("pivots").alias("doc"))
    own = texts.select(F.col("doc_id").alias("doc"), "text")
    rows = members.union(pivots).join(own, "doc")
    rows = rows.select("pivots", "part", "doc", "least", "text").repartition("pivots", "part")
    rows = rows.sortWithinPartitions("pivots", "part", F.col("least").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, union = None, np.empty(0, np.uint64)
        for batch in batches:
            groups, parts, docs, leasts, bodies = (column.to_pylist() for column in batch.columns)
            found: list[list] = [[], [], [], []]
            for pivots, part, doc, least, own in zip(groups, parts, docs, leasts, shingle_sets(bodies)):
                if (pivots, part) != key:
                    key, union = (pivots, part), np.empty(0, np.uint64)
                if least is None:
                    union = np.union1d(union, own)
                    continue
                tokens, bounds = _lacking(own, union, least, percent)
                found[0] += [pivots] * len(tokens)
                found[1] += [doc] * len(tokens)
                found[2] += tokens
                found[3] += bounds
            kinds = [pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(column, kind) for column, kind in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["pivots", "doc", "token", "bound"])

    return map_arrow(rows, run, TOKENS)


def _lacking(own: np.ndarray, union: np.ndarray, least: int, percent: int) -> tuple[list, list]:
    """A member's tokens and bounds, one list each; see :func:`_tokens`."""
    added = np.setdiff1d(own, union, assume_unique=True)
    common = len(own) - len(added)
    # No set smaller than this can be linked with the member at all.
    least = max(least, -(-percent * len(own) // 100))
    needed = -(-percent * (len(own) + least) // (100 + percent)) - common
    if needed <= 0:
        bound = (100 + percent) * common // percent - len(own)
        return [*added.view(np.int64).tolist(), None], [*[None] * len(added), bound]
    added = added[: max(0, len(added) - needed + 1)]
    return added.view(np.int64).tolist(), [None] * len(added)


def _regrouped(
    named: DataFrame, weights: DataFrame, texts: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame]:
    """The groups of the next round, and pairs that must be compared directly.

    ``named`` has groups with more than one label.
    """
    tokens = stored(_tokens(named, texts, percent), "tokens")
    key = ["pivots", "token"]
    labelled = tokens.filter("token IS NOT NULL").join(
        named.select("pivots", "doc", "label"), ["pivots", "doc"]
    )
    several = labelled.groupBy(*key).agg(F.min("label").alias("x"), F.max("label").alias("y"))
    keyed = labelled.join(several.filter("x <> y").select(*key), key, "left_semi")
    keyed = keyed.join(weights, "doc").select(*key, "doc", "weight", "label")
    keyed = stored(_sized(keyed, key), "keyed")
    few, many = keyed.filter(F.col("size") <= FEW), keyed.filter(F.col("size") > FEW)
    chosen = many.groupBy(*key).agg(F.max(F.struct("weight", "doc"))["doc"].alias("pivot"))
    again = (
        many.join(chosen, key)
        .filter("doc <> pivot")
        .select(F.concat("pivots", F.array("pivot")).alias("pivots"), "doc")
        .distinct()
    )
    close = tokens.filter("token IS NULL").select("pivots", F.col("doc").alias("x"), "bound")
    own = named.select("pivots", F.col("doc").alias("x"), F.col("label").alias("label_x"))
    # Of two members with different labels one has not the group's most common label.
    counts = named.groupBy("pivots", "label").agg(F.count("*").alias("size"))
    common = counts.groupBy("pivots").agg(F.max(F.struct("size", "label"))["label"].alias("common"))
    direct = (
        close.join(own, ["pivots", "x"])
        .join(common, "pivots")
        .filter("label_x <> common")
        .join(named, "pivots")
        .filter("n <= bound AND label <> label_x AND doc <> x")
        .select(F.least("doc", "x").alias("a"), F.greatest("doc", "x").alias("b"))
    )
    return again, direct.union(_among_few(few, key))


def _sized(keyed: DataFrame, key: list[str]) -> DataFrame:
    return keyed.join(keyed.groupBy(*key).agg(F.count("*").alias("size")), key)


def _among_few(keyed: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of members with different labels, for keys of at most FEW members.

    Every member of such a key is a pivot for the others. Most keys of a family have the same
    members, which are taken once.
    """
    lists = keyed.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("doc", "label"))).alias("members")
    )
    one = lists.select("members").distinct().select("members", F.explode("members").alias("x"))

    def other(member):
        return (member["doc"] > F.col("x.doc")) & (member["label"] != F.col("x.label"))

    both = one.select("x.doc", F.explode(F.filter("members", other)).alias("y"))
    return both.select(F.col("doc").alias("a"), F.col("y.doc").alias("b"))


def link(marks: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``node`` and ``root`` of the components of linked classes, for all but the roots.

    ``marks`` has one row per class; ``docs`` has the texts.
    """
    members = stored(_buckets(marks, settings), "buckets")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    wanted = members.select(F.col("doc").alias("doc_id")).distinct()
    texts = stored(
        rows.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts"
    )
    marks = stored(marks.join(wanted, "doc_id", "left_semi"), "marks")
    sizes = marks.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"))
    groups, weights = _groups(members)
    direct = tested = labels = None
    while True:
        groups = stored(groups, "groups")
        pivot = F.element_at("pivots", -1)
        pairs = groups.select(F.least(pivot, "doc").alias("a"), F.greatest(pivot, "doc").alias("b"))
        pairs = pairs.filter("a <> b")
        if direct is not None:
            pairs = pairs.union(direct)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        found = stored(verified(survivors(pairs, marks, settings), texts, settings), "verified")
        tested = pairs if tested is None else tested.union(pairs)
        if not found.isEmpty():
            # What is known counts as one link per document, whatever the number of links it came from.
            labels = components(found if labels is None else found.union(labels.select("node", "root")))
        named, label = groups.filter(pivot != F.col("doc")), F.col("doc")
        if labels is not None:
            named = named.join(labels.withColumnRenamed("node", "doc"), "doc", "left")
            label = F.coalesce("root", "doc")
        named = named.select("pivots", "doc", label.alias("label")).join(sizes, "doc")
        several = named.groupBy("pivots").agg(F.min("label").alias("x"), F.max("label").alias("y"))
        named = named.join(several.filter("x <> y").select("pivots"), "pivots", "left_semi")
        named = stored(named.select("pivots", "doc", "label", "n"), "named")
        if named.isEmpty():
            break
        groups, direct = _regrouped(named, weights, texts, settings.percent)
    if labels is None:
        return marks.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root")).limit(0)
    return labels


def groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: one row per row of ``docs``.

    A document without words, NULL text included, is linked with nothing. Rows of one doc_id are
    one document and must have one text. Rows without a doc_id are linked with
    nothing and have no component_id; they are kept. Other columns are not read.
    """
    every = stored(signatures(docs, settings), "signatures")
    named = every.filter(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull())
    classes = stored(named.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"))
    marks = stored(
        named.select("doc_id", "n_shingles", "signature")
        .join(reps, "doc_id", "left_semi")
        .dropDuplicates(["doc_id"]),
        "marks",
    )
    labels = link(marks, docs, settings)
    of_class = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        "set_id", F.coalesce("root", "rep").alias("class_root")
    )
    return (
        every.drop("signature")
        .join(of_class, "set_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("class_root", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are the smallest document of their group, unchanged."""
    dropped = groups(docs, settings).filter(~F.col("kept")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
