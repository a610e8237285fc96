"""WARC archives in seekable Zstandard bundles.

A bundle is a row of independent frames, each a group of whole records, and ends with a
skippable frame that holds the seek table: the sizes of all frames, packed and unpacked. The
record index, a Parquet table, maps a record's identifier to its bundle, its frame and
its offset in the unpacked frame, so that one record costs one frame to read.

Pages of equal payload are stored once: the one of the smallest page_id as ``response``, the
others as ``revisit`` records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream.llm.common import attempt_name, join_sized, stored

# Unpacked bytes after which a frame ends, and packed bytes after which a bundle ends.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 30
# Frames that a reading task unpacks, on average.
TASK_FRAMES = 16
LEVEL = 3
RECORD_DATE = "1970-01-01T00:00:00Z"
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")

INDEX = "record_id string, bundle string, frame int, offset long, length long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def page_of(identifier: str) -> int | None:
    number = identifier.rpartition(":")[2]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record; ``first`` is the page that a revisit refers to."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if first is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if url is not None:
        # Control characters and non-ASCII would end or break the header.
        lines.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~')}")
    if first is not None:
        lines.append(f"WARC-Refers-To: <{record_id(first)}>")
        lines.append(
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        )
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, their names in lower case, and the rest after the empty line."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}, rest


class BundleWriter:
    """Packs records into the frames of one bundle."""

    def __init__(self, stream):
        self.stream = stream
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.records: list[bytes] = []
        self.pending = 0
        self.frames: list[tuple[int, int]] = []
        self.packed = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset and length of the record."""
        if self.pending and self.pending + len(data) > FRAME_BYTES:
            self.end_frame()
        place = (len(self.frames), self.pending, len(data))
        self.records.append(data)
        self.pending += len(data)
        return place

    def end_frame(self) -> None:
        if not self.records:
            return
        packed = self.packer.compress(b"".join(self.records))
        self.stream.write(packed)
        self.frames.append((len(packed), self.pending))
        self.packed += len(packed)
        self.records, self.pending = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(ENTRY.pack(*sizes) for sizes in self.frames)
        table += FOOTER.pack(len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        count, _, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the bundle")
        length = count * ENTRY.size
        table = file.read_at(length, size - FOOTER.size - length)
        self.starts, place = [], 0
        for packed, unpacked in ENTRY.iter_unpack(table):
            self.starts.append((place, packed, unpacked))
            place += packed
        self.unpacker = zstandard.ZstdDecompressor()
        self.current = (-1, b"")

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if self.current[0] != frame:
            place, packed, unpacked = self.starts[frame]
            data = self.unpacker.decompress(self.file.read_at(packed, place), unpacked)
            self.current = (frame, data)
        return self.current[1][offset : offset + length]


def with_first(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and ``first``: for a revisit the page it refers to, else NULL.

    Rows that repeat the smallest page_id of their payload are responses too. Digests that
    several rows share are stored first: few are broadcast, and payloads stay where they are; with
    many, payloads meet them in a join that adaptive execution can split where one is very common.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = (
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
        .withColumn("key", F.unhex(F.sha1("payload")))
    )
    repeated = stored(
        rows.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("key")
        .agg(F.min("page_id").alias("smallest"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n"),
        "repeated-payloads",
    )
    first = F.when(
        ~F.col("page_id").eqNullSafe(F.col("smallest")), F.col("smallest")
    )
    joined = join_sized(rows, repeated, "key", "left")
    return joined.select("page_id", "url", "payload", first.alias("first"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` and returns the record index.

    A NULL html is an empty payload; payloads under ``least_bytes`` are all responses; rows
    without a page_id get an identifier without a number; other columns are not read.
    """
    names = [field.strip().split()[0] for field in INDEX.split(",")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        prefix = f"pages-{TaskContext.get().partitionId():06d}"
        name, writer = "", None
        for batch in batches:
            index = []
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first"))
            for page_id, url, payload, first in zip(*columns):
                if writer is not None and writer.packed >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
                if writer is None:
                    name = f"{attempt_name(prefix)}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None))
                place = writer.add(record(page_id, url, payload, first))
                index.append((record_id(page_id), name, *place))
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*index), kinds)]
            if arrays:
                yield pa.RecordBatch.from_arrays(arrays, names)
        if writer is not None:
            writer.close()

    index = with_first(pages, least_bytes).mapInArrow(run, INDEX)
    index.write.parquet(f"{folder}/index")
    return read_index(pages.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, url string, payload binary"
)


def parse(data: bytes) -> tuple:
    """The READ columns of one record. A response's digest is that of its stored payload."""
    fields, block = headers(data)
    block = block[: int(fields["content-length"])]
    http, payload = headers(block)
    kind = fields["warc-type"]
    refers = fields.get("warc-refers-to")
    revisit = kind == "revisit"
    return (
        page_of(fields["warc-record-id"].strip("<>")),
        int(http["content-length"]) if revisit else len(payload),
        fields["warc-payload-digest"].removeprefix("sha1:") if revisit else digest(payload),
        kind,
        page_of(refers.strip("<>")) if refers else None,
        fields.get("warc-target-uri"),
        None if revisit else payload,
    )


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names, each frame unpacked once; READ columns."""
    names = [field.strip().split()[0] for field in READ.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, reader = None, None
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))
            for bundle, frame, offset, length in zip(*columns):
                if bundle != name:
                    name, reader = bundle, BundleReader(fs.open_input_file(f"{root}/{bundle}"))
                rows.append(parse(reader.record(frame, offset, length)))
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            if arrays:
                yield pa.RecordBatch.from_arrays(arrays, names)

    # Tasks by what the rows name, which is far more than the rows: TASK_FRAMES frames or so
    # each. A bundle is read by several.
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()["bytes"]
    tasks = 1 + total // (TASK_FRAMES * FRAME_BYTES)
    run_of_frames = F.floor(F.col("frame") / TASK_FRAMES)
    placed = index.repartition(tasks, "bundle", run_of_frames).sortWithinPartitions(
        "bundle", "frame", "offset"
    )
    return placed.mapInArrow(run, READ)
