"""Language identification with bit-sliced Bloom filters of character n-grams.

For every learned language one Bloom filter holds the n-grams that belong to it. The filters are stored
sliced by position: a word per position whose bit L says whether filter L has that position set. One lookup of an
n-gram is the AND of its positions' words: the mask of all languages that (seem to) contain it. Counting the bits
of a text's masks by language gives its hits, of which a filter's false positives take their expected share away.

Learning counts, per language, the documents that hold each n-gram. Tasks count in numpy, and
hand on partial counts whenever their table is full; Spark adds them up. The filters have a fixed number of
positions, whatever the corpus, and this bounded table alone passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstream.llm.common import map_batches, stored

# n-grams are three characters of a word with a space before and behind it, packed into 63 bits.
CODE_BITS = 21
# A filter holds an n-gram if this share of its language's documents has it, two documents at least, ...
COMMON = 0.005
# ... and the share is not below this part of the largest share that any language has: a word quoted now and then
# does not belong to the language that quotes it.
RELATIVE = 0.25
# Positions of each filter, a power of two, and how many of them an n-gram sets.
POSITIONS = 1 << 20
HASHES = 4
# Languages a word of the sliced filters holds (the sign bit stays free).
SLICE = 63
# Distinct n-grams a task counts before it hands them on.
TABLE = 1 << 20
# Learned values of the language column.
MOST_LANGUAGES = 1024
NOT_KNOWN = "und"

_COUNTS = "lang string, gram long, docs long"


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point whether it is a letter, and its lower case; a space stands for all but letters."""
    letter = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
    lower = np.full(len(letter), 0x20, np.uint64)
    for c in np.flatnonzero(letter):
        lower[c] = ord(chr(c).lower()[0])
    return letter, lower


def grams(text: str | None) -> np.ndarray | None:
    """A text's n-grams as numbers, one per occurrence; None for a text without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letter, lower = _characters()
    letter = letter[codes]
    if not letter.any():
        return None
    # Words with one space between, before and behind.
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    line = np.full(int(kept.sum()) + 2, 0x20, np.uint64)
    line[1:-1] = lower[codes[kept]]
    if line[-2] == 0x20:
        line = line[:-1]
    middle = line[1:-1]
    # A space in the middle spans two words.
    inner = middle != 0x20
    packed = (line[:-2] << np.uint64(2 * CODE_BITS)) | (middle << np.uint64(CODE_BITS)) | line[2:]
    return packed[inner]


def positions(grams: np.ndarray, size: int, count: int) -> np.ndarray:
    """The filter positions of each n-gram, a row per hash: double hashing of the mixed bits."""
    with np.errstate(over="ignore"):
        first = grams * np.uint64(0x9E3779B97F4A7C15)
        first ^= first >> np.uint64(32)
        second = (first * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        second ^= (second >> np.uint64(33)) << np.uint64(1)
        steps = (first + np.uint64(k) * second for k in range(count))
        return np.stack([step & np.uint64(size - 1) for step in steps]).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per language and n-gram; partial counts leave whenever the table is full."""
    waiting: dict[str, list[np.ndarray]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in waiting.items():
            gram, docs = np.unique(np.concatenate(parts), return_counts=True)
            columns = [pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(docs)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "docs"])
        waiting.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            found = grams(text)
            if found is not None:
                mine = np.unique(found)
                waiting.setdefault(lang, []).append(mine)
                size += len(mine)
            if size > TABLE:
                yield from out()
                size = 0
    yield from out()


@dataclass
class Model:
    """Sliced filters of the learned languages, in the order of their training documents, most first."""

    languages: list[str]
    words: np.ndarray  # slices x positions
    hashes: int

    def __post_init__(self):
        self.false = np.array(
            [self.fill(i) ** self.hashes for i in range(len(self.languages))], np.float64
        )

    def _bits(self, words: np.ndarray, language: int) -> np.ndarray:
        return (words[language // SLICE] >> np.int64(language % SLICE)) & np.int64(1)

    def fill(self, language: int) -> float:
        """Share of a filter's positions that are set."""
        return float(self._bits(self.words, language).mean())

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains, without those expected by chance."""
        at = positions(hashes, self.words.shape[1], self.hashes)
        masks = self.words[:, at[0]]
        for row in at[1:]:
            masks &= self.words[:, row]
        raw = np.array([self._bits(masks, i).sum() for i in range(len(self.languages))], np.float64)
        # raw = real + (all - real) * false
        room = np.maximum(1 - self.false, 1e-9)
        return np.clip((raw - len(hashes) * self.false) / room, 0, None)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the most hits, and its share of all languages' hits."""
        found = grams(text)
        if found is None or not self.languages:
            return NOT_KNOWN, 0.0
        real = self.hits(found)
        total = real.sum()
        best = int(np.argmax(real))
        return self.languages[best], float(real[best] / total) if total > 0 else 0.0


def learn(
    docs: DataFrame,
    common: float = COMMON,
    relative: float = RELATIVE,
    size: int = POSITIONS,
    hashes: int = HASHES,
) -> Model:
    """Filters from all ``docs`` (text, lang); rows without either, or without letters, teach nothing.

    More than MOST_LANGUAGES values of lang raise ValueError: they are no languages.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    seen = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(seen) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = stored(
        rows.mapInArrow(_count, _COUNTS).groupBy("lang", "gram").agg(F.sum("docs").alias("docs")), "grams"
    )
    order = sorted((-row["count"], row["lang"]) for row in seen)
    languages = [lang for _, lang in order]
    slices = max(-(-len(languages) // SLICE), 1)
    words = np.zeros((slices, size), np.int64)
    if not languages:
        return Model([], words, hashes)
    number = F.create_map(*(F.lit(v) for i, lang in enumerate(languages) for v in (lang, i)))
    total = F.create_map(*(F.lit(v) for n, lang in order for v in (lang, -n)))
    share = F.col("docs") / total[F.col("lang")]
    kept = (
        counts.withColumn("share", share)
        .withColumn("most", F.max("share").over(Window.partitionBy("gram")))
        .filter((F.col("docs") >= 2) & (F.col("share") >= common) & (F.col("share") >= relative * F.col("most")))
        .select(number[F.col("lang")].alias("language"), "gram")
    )

    def set_bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        gram = batch.column("gram").to_numpy().view(np.uint64)
        language = batch.column("language").to_numpy().astype(np.int64)
        at = positions(gram, size, hashes).ravel()
        bit = np.tile(np.int64(1) << (language % SLICE), hashes)
        part = np.tile(language // SLICE, hashes)
        return pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(at), pa.array(bit)], ["part", "place", "bits"]
        )

    bits = map_batches(kept, set_bits, "part long, place long, bits long")
    bits = bits.groupBy("part", "place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[bits["part"].to_numpy(), bits["place"].to_numpy()] = bits["bits"].to_numpy()
    return Model(languages, words, hashes)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Each row's language by its text: lang_pred, score; other columns stay, but for these two.

    A NULL text, and one without letters, is ``und`` with score 0; so is every text if nothing was learned. A text
    that hits no filter gets the most common language of the training documents, with score 0; of equal hits the
    language with more training documents wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [name for name in docs.columns if name not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        found = [model.predict(text) for text in batch.column("text").to_pylist()]
        langs, scores = zip(*found)
        columns = [batch.column(name) for name in kept]
        columns += [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    return map_batches(docs, predict, schema)


def held_out(doc_id: str, parts: int = 4, part: int = 2) -> Column:
    """Whether the checksum of an id leaves the remainder that is kept from learning; a NULL id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))
