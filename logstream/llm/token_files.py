"""Token ids of documents as flat files that are memory-mapped to read.

A data set is a folder of parts and a manifest. A part holds the ids of consecutive
documents one after another (``.bin``, unsigned 16 or 32 bits, little-endian), the n + 1
offsets of its n documents (``.idx``, 64 bits) and their doc_ids (``.doc``, 64 bits; the
smallest number stands for NULL). The manifest, a Parquet table, has one row per part; a
prefix sum over its token counts gives each part's base, so any token has a global place.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logstream.llm.common import attempt_name, text_or_empty

NULL_ID = np.iinfo(np.int64).min
# Chunks a worker remembers at least and, times two, at most; and the longest remembered.
KNOWN_CHUNKS = 1_000_000
KNOWN_LENGTH = 64
# A plain word and what follows it: letters that have one lower-case form and do not combine.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-þ]+)([.,;:!?]*)")
# Documents a reading task hands on at once.
READ_DOCS = 2000
MANIFEST = "part int, name string, dtype string, n_docs long, n_tokens long"


class Encoder:
    """Encodes texts; quickly so with a vocabulary that drops white space and upper case.

    With other vocabularies each text is encoded as a whole. With such a one, what stands between two spaces is then encoded alike wherever it occurs, so that each
    chunk goes through the tokenizer once and is remembered, up to a bounded number: chunks that
    were not met since the last half of them was dropped are forgotten. It never joins letters
    with marks either: a plain word is looked up in lower case and apart from the marks behind
    it, and needs neither the normalizer nor the pattern.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        found = [
            [step["type"] for step in (steps[kind] or {}).get(name, [])]
            for kind, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
        ]
        self.by_chunk = found == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text, as they stand in a file."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not self.by_chunk:
            return list(self._ids(self.tokenizer, texts.to_pylist()))
        # Chunks by text, each distinct one with its number.
        split = pc.ascii_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        own = pa.array(self._look_up(chunks.dictionary.to_pylist()), pa.binary())
        placed = own.take(chunks.indices)
        _, offsets, data = placed.buffers()
        ends = np.frombuffer(offsets, np.int32)[placed.offset + split.offsets.to_numpy()].tolist()
        ids = memoryview(data or b"")
        return [bytes(ids[start:end]) for start, end in zip(ends, ends[1:])]

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        if len(self.known) > KNOWN_CHUNKS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = list(map(known.get, chunks))
        missing = [place for place, ids in enumerate(found) if ids is None]
        plain: dict[int, re.Match] = {}
        words: dict[str, bytes | None] = {}
        others: dict[str, bytes | None] = {"": b""}
        for place in missing:
            chunk = chunks[place]
            ids = found[place] = older.get(chunk)
            if ids is not None:
                continue
            match = PLAIN.fullmatch(chunk)
            if match:
                plain[place] = match
                words[match[1].lower()] = None
                others[match[2]] = None
            else:
                others[chunk] = None
        for tokenizer, wanted in ((self.plain, words), (self.tokenizer, others)):
            wanted.update(zip(list(wanted), self._ids(tokenizer, list(wanted))))
        for place in missing:
            chunk, match = chunks[place], plain.get(place)
            if match:
                found[place] = words[match[1].lower()] + others[match[2]]
            elif found[place] is None:
                found[place] = others[chunk]
            if len(chunk) <= KNOWN_LENGTH:
                known[chunk] = found[place]
        return found

    def _ids(self, tokenizer, words: list[str]) -> Iterator[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        for start in range(0, len(words), 20_000):
            some = words[start : start + 20_000]
            for one in tokenizer.encode_batch_fast(some, add_special_tokens=False):
                yield array(kind, one.ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order; returns the manifest.

    ``end_id`` follows each document. A NULL text counts as empty, a NULL doc_id comes
    first, rows of equal doc_id follow each other by text, and other columns are not read.
    A lost task writes files of another name; only those of the successful one are listed.
    """
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col("doc_id").cast("long"), text_or_empty())
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end = np.array([end_id], own.dtype).tobytes()
        part = TaskContext.get().partitionId()
        name = attempt_name(f"part-{part:06d}")
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        total, n_docs = 0, 0
        with (
            fs.open_output_stream(f"{root}/{name}.bin", compression=None) as ids,
            fs.open_output_stream(f"{root}/{name}.idx", compression=None) as index,
            fs.open_output_stream(f"{root}/{name}.doc", compression=None) as names,
        ):
            index.write(np.array([0], "<i8").tobytes())
            for batch in batches:
                encoded = own.encode(batch.column("text"))
                ids.write(b"".join(one + end for one in encoded))
                sizes = [len(one) // own.dtype.itemsize + 1 for one in encoded]
                offsets = total + np.cumsum(np.array(sizes, "<i8"))
                index.write(offsets.astype("<i8").tobytes())
                names.write(
                    np.array(
                        batch.column("doc_id").fill_null(int(NULL_ID)).to_numpy(), "<i8"
                    ).tobytes()
                )
                total, n_docs = total + sum(sizes), n_docs + len(sizes)
        row = [[part], [name], [own.dtype.str], [n_docs], [total]]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        columns = [pa.array(value, kind) for value, kind in zip(row, kinds)]
        names = ["part", "name", "dtype", "n_docs", "n_tokens"]
        yield pa.RecordBatch.from_arrays(columns, names)

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The parts with documents, each with ``base``: the tokens of all parts before it.

    The prefix sum runs in one task over one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        spark.read.schema(MANIFEST)
        .parquet(f"{folder}/manifest")
        .filter("n_docs > 0")
        .withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    )


def mapped(folder: str, name: str):
    """An open file: memory-mapped where the file system is a local one."""
    fs, root = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(f"{root}/{name}")
    return fs.open_input_file(f"{root}/{name}")


def documents(
    folder: str, row: dict, count: int = READ_DOCS
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, offsets and ids of ``count`` documents of a part at a time."""
    dtype = np.dtype(row["dtype"])
    with (
        mapped(folder, f"{row['name']}.bin") as ids,
        mapped(folder, f"{row['name']}.idx") as index,
        mapped(folder, f"{row['name']}.doc") as names,
    ):
        for first in range(0, row["n_docs"], count):
            size = min(count, row["n_docs"] - first)
            offsets = np.frombuffer(index.read_at(8 * (size + 1), 8 * first), "<i8")
            keys = np.frombuffer(names.read_at(8 * size, 8 * first), "<i8")
            length = int(offsets[-1] - offsets[0]) * dtype.itemsize
            place = int(offsets[0]) * dtype.itemsize
            yield keys, offsets, np.frombuffer(ids.read_at(length, place), dtype)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from the files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for keys, offsets, ids in documents(folder, row):
                    wide, begin = ids.astype("<u4"), offsets - offsets[0]
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(begin, begin[1:])]
                    columns = [
                        pa.array(keys, pa.int64(), mask=keys == NULL_ID),
                        pa.array(row["base"] + offsets[:-1], pa.int64()),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(crc, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    parts = manifest(spark, folder)
    # One task per file: its row is small, what it names is not.
    spread = parts.repartition(max(1, parts.count()), "name")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
