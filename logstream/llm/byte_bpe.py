"""Byte-level BPE: every distinct word of the corpus is encoded once, for all documents.

Texts are split into pre-tokens with their positions. A block of documents keeps each of its
distinct words once, and its positions as numbers of those words. The words of all
blocks are shuffled by word and encoded once each, the ids go back to the blocks that
hold the word, and each block puts its documents together by position. What travels is
words and positions, never texts.

Decoding joins the ids that a batch of documents uses, each once, to the table of token bytes,
and puts the bytes together by position.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream.llm.common import map_arrow, text_or_empty

# A block ends with the document in which it reaches so many pre-tokens.
BLOCK_TOKENS = 8_000_000
# A word's place is 63 bits: the partition of the scan, the block in it, the word in the block. A block has
# fewer words than its last text has bytes and BLOCK_TOKENS more, of which 2 ** 30 cannot differ.
NUMBER_BITS, BLOCK_BITS, PART_BITS = 30, 12, 21
ONE_BLOCK = (1 << NUMBER_BITS) - 1
# Documents packed into one row, and characters after which the row is full.
PACK_DOCS = 256
PACK_CHARS = 1 << 20
# Encoded words that wait in a task until they are sent to their blocks.
WAITING_WORDS = 500_000
# Bytes of ids after which a task hands documents on.
OUT_BYTES = 2 << 20
# Largest vocabulary that is broadcast, in entries.
VOCABULARY_ROWS = 1 << 20
# Code points that are told apart at a time.
SOME_POINTS = 1 << 16
# Pre-tokens that are cut out of a pack at a time.
SOME_WORDS = 1 << 14

LETTER, NUMBER, SPACE, OTHER, END = range(5)
# The endings that the pattern splits off with their apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def members(pattern: str) -> np.ndarray:
    """The code points that a pattern matches, as the encoding library reads it."""
    import tiktoken

    single = {bytes([value]): value for value in range(256)}
    plain = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
    found = []
    for first in range(0, 0x110000, SOME_POINTS):
        points = (p for p in range(first, first + SOME_POINTS) if not 0xD800 <= p < 0xE000)
        text = bytes(plain.encode_ordinary("".join(map(chr, points)))).decode()
        found.append(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    return np.concatenate(found)


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        kinds[members(pattern)] = kind
    return kinds


def pre_tokens(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The pre-tokens of all texts, in order, and how many each text has.

    Equal to matching ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    again and again, on all texts at once. A character that ends each text keeps them apart.
    """
    joined = "\0".join([*texts, ""])
    if not joined:
        return [], np.zeros(len(texts), np.int64)
    data = joined.encode()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = character_kinds()[points]
    ends = np.cumsum([len(text) + 1 for text in texts]) - 1
    kinds[ends] = END
    starts = np.ones(len(points) + 1, bool)
    starts[1:-1] = kinds[1:] != kinds[:-1]
    # Of white space before something else the last character stands apart; a plain
    # space begins what follows.
    after = 1 + np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (kinds[1:] != END))
    starts[after - 1] = True
    starts[after] = points[after - 1] != 32
    # An apostrophe that begins a pre-token takes one of the endings with it.
    marks = np.flatnonzero((points == 39) & starts[:-1])
    following = kinds[np.minimum(marks + 1, len(points) - 1)]
    for mark in marks[following == LETTER]:
        for ending in ENDINGS:
            if joined.startswith(ending, mark + 1):
                starts[mark + 1] = False
                starts[mark + 1 + len(ending)] = True
                break
    starts[ends] = True
    starts[ends + 1] = True
    places = np.flatnonzero(starts)
    widths = np.ones(len(points), np.uint8)
    for longer in (0x80, 0x800, 0x10000):
        widths += points >= longer
    sizes = np.add.reduceat(widths, places[:-1], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    real = kinds[places[:-1]] != END
    counts = np.diff(np.concatenate(([0], np.cumsum(real)[np.searchsorted(places, ends)])))
    firsts, lasts, words = offsets[:-1][real], offsets[1:][real], []
    for some in range(0, len(firsts), SOME_WORDS):
        part = slice(some, some + SOME_WORDS)
        words += [data[a:b] for a, b in zip(firsts[part].tolist(), lasts[part].tolist())]
    return words, counts


class Numbers(dict):
    """Numbers the words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """Partition, doc_ids and texts, a bounded number at a time."""
    ids, texts, size, part = [], [], 0, 0
    for batch in batches:
        part = batch.column("part")[0].as_py() if batch.num_rows else part
        for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if len(ids) >= PACK_DOCS or size >= PACK_CHARS:
                yield part, ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield part, ids, texts


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per pack: block, numbers of its words so far, doc_ids, counts, numbers; None at its end.

    The cuts follow from the rows' order alone, so that every pass over a file makes the same.
    """
    numbers, tokens, made = Numbers(), 0, 0
    for part, doc_ids, texts in packs(batches):
        words, counts = pre_tokens(texts)
        found = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
        tokens += len(words)
        # The next pack is split without the words of this one.
        del words
        yield block_of(part, made), numbers, doc_ids, counts, found
        if tokens >= BLOCK_TOKENS:
            yield block_of(part, made), numbers, None, None, None
            numbers, tokens, made = Numbers(), 0, made + 1
    if numbers:
        yield block_of(part, made), numbers, None, None, None


def block_of(part: int, made: int) -> int:
    """A block's number, from its partition and its place there."""
    if part >> PART_BITS or made >> BLOCK_BITS:
        raise ValueError(f"block {made} of partition {part} is beyond what a word's place can name")
    return (part << BLOCK_BITS) | made


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, packed by byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: token bytes and their rank, which is the id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def piece_encoder(path: str):
    """Encodes the bytes of one pre-token; one for each Python worker."""
    import tiktoken

    return tiktoken.Encoding(
        "ranks", pat_str=r"\S+", mergeable_ranks=ranks(path), special_tokens={}
    )._core_bpe.encode_single_piece


def numbering(numbers: np.ndarray, sums: np.ndarray) -> int:
    """Sum over words, by number and checksum: it tells two numberings of the same words apart."""
    odd = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    mixed = (sums.astype(np.uint64) + np.uint64(1)) * (odd ^ (odd >> np.uint64(29)))
    return int(mixed.sum(dtype=np.uint64).view(np.int64))


WORDS = "place long, word binary"
BLOCK_KINDS = {
    "block": ("long", pa.int64()),
    "doc_ids": ("array<long>", pa.list_(pa.int64())),
    "counts": ("array<int>", pa.list_(pa.int32())),
    "numbers": ("binary", pa.binary()),
    "words": ("binary", pa.binary()),
    "check": ("long", pa.int64()),
}
BLOCK_NAMES = list(BLOCK_KINDS)
BLOCK_ROWS = ", ".join(f"`{name}` {kind}" for name, (kind, _) in BLOCK_KINDS.items())


def distinct_words(docs: DataFrame) -> DataFrame:
    """Every block's distinct words; ``place`` is the block and the word's number in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, numbers, doc_ids, _, _ in blocks(batches):
            if doc_ids is None:
                # Alphabetical: neighbours share beginnings, which packs well.
                words = sorted(numbers)
                places = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                for first in range(0, len(words), 50_000):
                    some = slice(first, first + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((block << NUMBER_BITS) | places[some], pa.int64()),
                            pa.array(words[some], pa.binary()),
                        ],
                        ["place", "word"],
                    )

    return map_arrow(docs, run, WORDS)


def positions(docs: DataFrame) -> DataFrame:
    """The documents as numbers of their block's words, by position; per block one more row, its numbering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, numbers, doc_ids, counts, found in blocks(batches):
            if doc_ids is not None:
                yield _block_row(block, doc_ids, counts, squeeze(found))
            else:
                sums = np.fromiter(map(zlib.crc32, numbers), np.uint32, len(numbers))
                yield _block_row(block, check=numbering(np.arange(len(sums)), sums))

    return map_arrow(docs, run, BLOCK_ROWS)


def _block_row(block, doc_ids=None, counts=None, numbers=None, words=None, check=None):
    row = (block, doc_ids, counts, numbers, words, check)
    arrays = [pa.array([value], kind) for value, (_, kind) in zip(row, BLOCK_KINDS.values())]
    return pa.RecordBatch.from_arrays(arrays, BLOCK_NAMES)


def encoded_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """Each distinct word encoded once; its ids, packed by block, for every block that has it.

    ``numbers`` holds the words' numbers, then their lengths in ids; ``words`` all their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_encoder(vocabulary)
        waiting: dict[int, tuple[array, ...]] = {}
        count, last, ids, crc = 0, None, [], 0
        for batch in batches:
            places = batch.column("place").to_pylist()
            for place, word in zip(places, batch.column("word").to_pylist()):
                if word != last:
                    last, ids, crc = word, encode(word), zlib.crc32(word)
                lists = waiting.get(place >> NUMBER_BITS)
                if lists is None:
                    lists = waiting[place >> NUMBER_BITS] = tuple(array("I") for _ in range(4))
                lists[0].append(place & ONE_BLOCK)
                lists[1].append(len(ids))
                lists[2].extend(ids)
                lists[3].append(crc)
            count += len(places)
            if count >= WAITING_WORDS:
                yield from _send(waiting)
                waiting, count = {}, 0
        yield from _send(waiting)

    ordered = words.repartition("word").sortWithinPartitions("word")
    return map_arrow(ordered, run, BLOCK_ROWS)


def _send(waiting: dict[int, tuple[array, ...]]) -> Iterator[pa.RecordBatch]:
    for block, lists in waiting.items():
        numbers, lengths, ids, sums = (np.frombuffer(values, np.uint32) for values in lists)
        packed = squeeze(np.concatenate((numbers, lengths)))
        check = numbering(numbers, sums)
        yield _block_row(block, numbers=packed, words=squeeze(ids), check=check)


class Words:
    """The ids of a block's words, by number."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        numbers = np.concatenate([p[0] for p in parts])
        lengths = np.concatenate([p[1] for p in parts]).astype(np.int64)
        self.ids = np.concatenate([p[2] for p in parts])
        if len(numbers) != int(numbers.max()) + 1:
            raise ValueError("the words of a block do not fit its documents")
        self.lengths = np.empty(len(numbers), np.int64)
        self.offsets = np.empty(len(numbers), np.int64)
        self.lengths[numbers] = lengths
        self.offsets[numbers] = np.cumsum(lengths) - lengths

    def placed(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many there are before each word."""
        lengths = self.lengths[found]
        before = np.concatenate(([0], np.cumsum(lengths)))
        index = np.arange(before[-1]) + np.repeat(self.offsets[found] - before[:-1], lengths)
        return self.ids[index], before


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and ``ids`` (unsigned 32 bits, little-endian): one row per row of ``docs``.

    ``docs`` must come from files: both passes over it must meet the rows in the same order. A
    block whose words were numbered otherwise in the other pass fails. A NULL or empty text has
    no ids, repeated rows are encoded each, an empty table gives no rows, and other columns are
    not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_or_empty(),
        # The partition of the scan, whatever stands above it.
        F.spark_partition_id().alias("part"),
    )
    return reassembled(encoded_words(distinct_words(rows), vocabulary), positions(rows))


def reassembled(words: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per document, from its block's encoded words and its positions."""
    # A block's words come before its documents.
    ordered = (
        words.unionByName(documents)
        .repartition("block")
        .sortWithinPartitions("block", F.col("doc_ids").isNotNull())
    )
    return map_arrow(ordered, _put_together, "doc_id long, n_tokens long, ids binary")


def token_table(spark: SparkSession, vocabulary: str) -> DataFrame:
    """``id`` and ``token``, its bytes: one row per entry of the vocabulary."""
    path = vocabulary if "://" in vocabulary else f"file://{vocabulary}"
    fields = F.split("value", " ")
    return spark.read.text(path).select(
        fields[1].cast("int").alias("id"), F.unbase64(fields[0]).alias("token")
    )


class Block:
    """What has come of a block: its words, and how either pass numbered them."""

    def __init__(self, number: int | None = None):
        self.number, self.parts, self.words = number, [], None
        self.sent, self.known = 0, 0

    def add(self, numbers: bytes | None, ids: bytes | None, check: int) -> None:
        if numbers is None:
            self.known += check
            return
        found = unsqueeze(numbers)
        half = len(found) // 2
        self.parts.append((found[:half], found[half:], unsqueeze(ids)))
        self.sent += check

    def placed(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.words is None:
            if (self.sent - self.known) % (1 << 64):
                raise ValueError("the words of a block do not fit its documents")
            if not self.parts:
                # Empty documents alone.
                return np.zeros(0, np.uint32), np.zeros(1, np.int64)
            self.words, self.parts = Words(self.parts), []
        return self.words.placed(found)


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, out, size = Block(), [], 0
    for batch in batches:
        for row in zip(*(batch.column(name) for name in BLOCK_NAMES)):
            number, doc_ids, counts, numbers, ids, check = (value.as_py() for value in row)
            if number != block.number:
                block = Block(number)
            if doc_ids is None:
                block.add(numbers, ids, check)
                continue
            placed, before = block.placed(unsqueeze(numbers))
            cuts = before[np.concatenate(([0], np.cumsum(counts)))].tolist()
            wide = placed.astype("<u4")
            for doc_id, a, b in zip(doc_ids, cuts, cuts[1:]):
                out.append((doc_id, b - a, wide[a:b].tobytes()))
            size += 4 * len(wide)
            if size >= OUT_BYTES:
                yield _encoded(out)
                out, size = [], 0
    if out:
        yield _encoded(out)


def _encoded(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids"])


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes its ``ids`` stand for.

    Rows are packed, as batches named by their content; a batch's distinct ids are joined to the
    token table, and their bytes meet the batch. A broadcast table leaves batches where they are; for a
    larger one they travel. NULL ids decode to NULL, no ids to no bytes; an id
    that the vocabulary lacks fails; repeated rows are decoded each; a column ``decoded`` is replaced.
    """
    encoded = encoded.drop("decoded")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.frombuffer(ids, "<u4") for ids in batch.column("ids").to_pylist() if ids]
            used = np.unique(np.concatenate(parts)).tolist() if parts else []
            packed = zstandard.ZstdCompressor(level=1).compress(_ipc(batch))
            name = hashlib.blake2b(packed, digest_size=16).digest()
            # The ids come before the rows that need them.
            columns = [[name] * (1 + len(used)), [None] * len(used) + [packed], [*used, None]]
            kinds = [pa.binary(), pa.binary(), pa.int32()]
            arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["batch", "rows", "id"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tokens = None, {}
        for batch in batches:
            for row in zip(*(batch.column(name) for name in ("batch", "rows", "id", "token"))):
                name, rows, one, token = (value.as_py() for value in row)
                if name != current:
                    current, tokens = name, {}
                if rows is None:
                    if token is not None:
                        tokens[one] = token
                    continue
                data = zstandard.ZstdDecompressor().decompress(rows)
                with pa.ipc.open_stream(data) as stream:
                    for found in stream:
                        for first in range(0, found.num_rows, PACK_DOCS):
                            some = found.slice(first, PACK_DOCS)
                            decoded = [
                                None
                                if ids is None
                                else b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
                                for ids in some.column("ids").to_pylist()
                            ]
                            yield some.append_column("decoded", pa.array(decoded, pa.binary()))

    packed = map_arrow(encoded, pack, "`batch` binary, `rows` binary, id int")
    tokens = token_table(encoded.sparkSession, vocabulary)
    if tokens.limit(VOCABULARY_ROWS + 1).count() <= VOCABULARY_ROWS:
        # Rows keep their task and order; were it otherwise, a token would be missing and the task fail.
        ordered = packed.join(F.broadcast(tokens), "id", "left")
    else:
        joined = packed.join(tokens, "id", "left")
        ordered = joined.repartition("batch").sortWithinPartitions("batch", F.col("rows").isNotNull())
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in encoded.dtypes)
    return map_arrow(ordered, unpack, f"{kinds}, decoded binary")


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def sha256(name: str):
    return F.sha2(F.col(name), 256)
