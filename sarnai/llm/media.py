"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, filled up with blanks to a positive multiple of 192, are the samples of an 8-bit grey
image 192 wide, kept losslessly as PNG. A task appends its images to a tar shard in the shared folder, each under
the SHA-256 of its payload and once per shard, and closes the shard before it gives out the rows that point into
it: digest, shard, offset, length. These rows are the manifest, written as a table whose commit decides which
shards count; a task that ran twice leaves a shard nothing points to. Of the places of one digest in several shards
the least is its address (``addresses``), and the only one that is read. Metadata columns come from the image
headers alone, read by range (``with_metadata``), once per address; ``read_back`` ranges over whole images.

The shared folder may be any store that pyarrow opens (file, hdfs, s3, gs). Null is an empty text; rows without an id and repeated rows
are rows like others, and an empty table has no shard.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarnai.llm.common import as_bytes, fresh_dir, to_arrow

UNIT = 192
SHARD_BYTES = 48_000_000
SHARD_ROWS = 100_000
TASK_BYTES = 32_000_000  # stored bytes that a task reads back
LEVEL = 1  # zlib level of the images
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and the IHDR chunk
MANIFEST = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"
ADDRESSES = "digest binary, shard string, offset long, length long"  # digests travel as their 32 bytes
METADATA = ADDRESSES + ", width int, height int, bits int"
READ = METADATA + ", tail_crc32 long, media_digest binary, feature string"


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits from an image's first bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no image header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode_png(media: bytes) -> bytes:
    width, height, _ = read_header(media[:HEADER])
    at, data = HEADER, b""
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data += media[at + 8 : at + 8 + size]
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean, spread and a 16-level histogram of the samples, as text."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = int(counts.sum()), np.arange(256)
    total, squares = int(counts @ values), int(counts @ (values * values))
    levels = counts.reshape(16, 16).sum(1)
    return f"{UNIT}x{n // UNIT};sum={total};sq={squares};" + ",".join(map(str, levels.tolist()))


class Shards:
    """A task's open shard. Members are written as they come; the file is moved into place when closed."""

    def __init__(self, folder: str):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.open = folder, None

    def add(self, digest: bytes, media: bytes) -> tuple[str, int, int]:
        if self.open is None:
            self.name = f"{uuid.uuid4().hex}.tar"
            self.store.create_dir(self.root, recursive=True)
            self.open, self.at, self.members = self.store.open_output_stream(f"{self.root}/{self.name}"), 0, {}
        if digest not in self.members:
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.open.write(head + media + b"\0" * (-len(media) % 512))
            self.members[digest] = (self.name, self.at + len(head), len(media))
            self.at += len(head) + len(media) + -len(media) % 512
        return self.members[digest]

    def full(self) -> bool:
        return self.open is not None and self.at >= SHARD_BYTES

    def close(self) -> None:
        if self.open is not None:
            self.open.write(b"\0" * 1024)
            self.open.close()
            self.open = None


def store_media(documents: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write every row's payload; the manifest and the folder of the shards."""
    spark = documents.sparkSession
    folder = folder or fresh_dir(spark, "media")
    arrow = to_arrow(spark, MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, rows = Shards(f"{folder}/shards"), []

        def given() -> Iterator[pa.RecordBatch]:
            shards.close()
            if rows:
                yield _batch(rows, arrow)
                rows.clear()

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                found = shards.members.get(digest) if shards.open is not None else None
                rows.append((doc, len(text), digest, *(found or shards.add(digest, encode_png(payload)))))
                if shards.full() or len(rows) >= SHARD_ROWS:
                    yield from given()
        yield from given()

    documents.select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(to_struct(spark, MANIFEST)).parquet(f"{folder}/manifest"), folder


def to_struct(spark, ddl: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl)


def _ranges(folder: str):
    """A reader of (shard, offset, length), one shard open at a time."""
    store, root = fs.FileSystem.from_uri(f"{folder}/shards")
    name, file = None, None

    def read(shard: str, offset: int, length: int) -> bytes:
        nonlocal name, file
        if shard != name:
            if file is not None:
                file.close()
            name, file = shard, store.open_input_file(f"{root}/{shard}")
        return file.read_at(length, offset)

    return read


def addresses(manifest: DataFrame) -> DataFrame:
    """One place of each digest."""
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    return manifest.groupBy("digest").agg(place).select("digest", "place.shard", "place.offset", "place.length")


def _dealt(places: DataFrame) -> DataFrame:
    """Places weigh far less than what they point to: dealt over the cores by the bytes to read, hot shards included."""
    stored = places.agg(F.sum("length")).first()[0] or 0
    spread = places.repartition(max(2 * places.sparkSession.sparkContext.defaultParallelism, stored // TASK_BYTES))
    return spread.sortWithinPartitions("shard", "offset")


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def with_metadata(places: DataFrame, folder: str, counter=None) -> DataFrame:
    """The addresses with width, height and bits, from range reads of ``HEADER`` bytes each; counter: an accumulator of bytes read."""
    arrow = to_arrow(places.sparkSession, METADATA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _ranges(folder)
        for b in batches:
            heads = [read(s, o, HEADER) for s, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            if counter is not None:
                counter.add(sum(map(len, heads)))
            rows = [(*place, *read_header(h)) for place, h in zip(zip(*(c.to_pylist() for c in b.columns), strict=True), heads, strict=True)]
            if rows:
                yield _batch(rows, arrow)

    return _dealt(places).select(*(c.split()[0] for c in ADDRESSES.split(", "))).mapInArrow(run, METADATA)


def read_back(described: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes say of each address; every image is read and decoded, and held against its digest and its metadata, so these are
    then known to be those of what was read."""
    arrow = to_arrow(described.sparkSession, READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _ranges(folder)
        for b in batches:
            rows = []
            for digest, shard, offset, length, width, height, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                media = read(shard, offset, length)
                payload = decode_png(media)
                if hashlib.sha256(payload).digest() != digest or len(payload) * 8 != width * height * bits:
                    raise ValueError(f"{shard} at {offset} does not hold {digest.hex()}")
                rows.append((digest, shard, offset, length, width, height, bits, zlib.crc32(payload[-16:]), hashlib.sha256(media).digest(), feature(payload)))
            if rows:
                yield _batch(rows, arrow)

    return described.select(*(c.split()[0] for c in METADATA.split(", "))).mapInArrow(run, READ)


def media_columns(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the metadata from the headers, the address, and what is read back, of every row. Stores the media first."""
    manifest, folder = store_media(documents)
    known = read_back(with_metadata(addresses(manifest), folder), folder)
    rows = manifest.select("doc_id", "n_bytes", F.col("digest").alias("of")).join(known, F.col("of") == F.col("digest"))
    text = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id", "n_bytes", text("digest").alias("digest"), "shard", "offset", "length", "width", "height", "bits", (F.col("width") * F.col("height") * F.col("bits") / 8).cast("long").alias("payload_bytes"),
        text("digest").alias("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), text("media_digest").alias("media_sha256"), "feature",
    )


def shard_members(media: bytes) -> list[tuple[str, int]]:
    """Names and sizes in a shard, as the standard library's tar reader sees them."""
    with tarfile.open(fileobj=io.BytesIO(media)) as t:
        return [(m.name, m.size) for m in t.getmembers()]
