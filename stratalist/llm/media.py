"""Operator 7: media columns over content-addressed payloads in tar shards.

Each text, as UTF-8 padded with zero bytes to a positive multiple of 64, becomes a lossless 8-bit grey PNG of 64 samples a
row. Every task packs its payloads into tar shards in the shared folder, each distinct payload once a shard under its digest. The manifest
names one place for each digest, and every row refers to that place by digest, shard, offset and length; what other shards hold of the same digest
is referred to by no row. Metadata columns (width, height, bits) come from range reads of the 33 header bytes
alone; features and read-back digests from one range read of each place of the manifest, dealt over tasks by their bytes. Texts are never shuffled;
a shard is named after the attempt that wrote it, and only shards of successful attempts are referred to, so lost executors do no harm.

Defined results: null and empty texts become one row of 64 zero bytes; equal texts have equal values, place included; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, new_path, table

WIDTH = 64
#: Bytes of a PNG up to the end of its header chunk.
HEADER_BYTES = 33
#: A task begins a new shard beyond that.
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, level: int = 4) -> bytes:
    """8-bit grey, 64 samples a row, no row filter."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def read_png(media: bytes) -> bytes:
    width, height, _ = read_header(media[:HEADER_BYTES])
    at, body = HEADER_BYTES, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Rows, mean and deviation of the samples, and the share of the commonest sample."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256).astype(float)
    mean = (counts @ np.arange(256)) / len(x)
    deviation = np.sqrt(counts @ (np.arange(256) - mean) ** 2 / len(x))
    return f"rows={len(x) // WIDTH};mean={mean:.4f};deviation={deviation:.4f};top={int(counts.argmax())}:{counts.max() / len(x):.4f}"


class _Shards:
    """Tar shards of one task."""

    def __init__(self, folder: str) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.out = None
        self.begin()

    def begin(self) -> None:
        self.end()
        self.files.create_dir(self.folder, recursive=True)
        self.name, self.at, self.known = f"{uuid.uuid4().hex}.tar", 0, {}
        self.out = self.files.open_output_stream(f"{self.folder}/{self.name}")

    def end(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None

    def put(self, payload: bytes) -> tuple[bytes, str, int, int]:
        digest = hashlib.sha256(payload).digest()
        if digest not in self.known:
            if self.at > SHARD_BYTES:
                self.begin()
            media = write_png(payload)
            member = tarfile.TarInfo(f"{digest.hex()}.png")
            member.size = len(media)
            head = member.tobuf(tarfile.GNU_FORMAT)
            self.out.write(head + media + bytes(-len(media) % 512))
            self.known[digest] = (self.at + len(head), len(media))
            self.at += len(head) + len(media) + -len(media) % 512
        return digest, self.name, *self.known[digest]


def store_payloads(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; doc_id, n_bytes, digest, shard, offset, length for each row, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shards = shards or _Shards(folder)
            texts = [t.as_py() or "" for t in batch.column("text")]
            digest, shard, offset, length = zip(*(shards.put(payload_of(t)) for t in texts), strict=True)
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(digest, pa.binary()), pa.array(shard), pa.array(offset, pa.int64()), pa.array(length, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shards is not None:
            shards.end()

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, digest binary, shard string, offset long, length long"), "media-index")


def manifest(index: DataFrame) -> DataFrame:
    """One place for each digest: of a hot digest, combined before the shuffle."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


#: Stored bytes that one task reads, about.
READ_BYTES = 16 << 20


def by_bytes(places: DataFrame) -> DataFrame:
    """The places in order of shard and offset, in as many tasks as their bytes need."""
    total = places.agg(F.sum("length")).first()[0] or 0
    return places.repartitionByRange(1 + int(total) // READ_BYTES, "shard", "offset").sortWithinPartitions("shard", "offset")


class _Reader:
    """Range reads of shards, one open at a time."""

    def __init__(self, folder: str) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.file = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.files.open_input_file(f"{self.folder}/{shard}")
        return self.file.read_at(length, offset)


def _ranges(index: DataFrame, folder: str, length, values, names: list[str], ddl: str) -> DataFrame:
    """Adds ``values(bytes of a range)`` to each row; equal ranges that follow each other closely are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = _Reader(folder), {}
        for batch in batches:
            out = []
            places = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True))
            for place in places:
                if place not in known:
                    if len(known) >= 50_000:
                        known.clear()
                    known[place] = values(reader.read(place[0], place[1], length or place[2]))
                out.append(known[place])
            added = [pa.array(x) for x in zip(*out, strict=True)] if out else []
            if added:
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    schema = T.StructType([*index.schema.fields])
    for part in ddl.split(", "):
        schema = schema.add(*part.split(" "))
    return index.mapInArrow(run, schema)


def header_columns(index: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bits to the rows of an index, reading only the headers."""
    return _ranges(index, folder, HEADER_BYTES, read_header, ["width", "height", "bits"], "width long, height long, bits long")


def content_columns(index: DataFrame, folder: str) -> DataFrame:
    """Adds payload_sha256, tail_crc32, media_sha256 and feature, from the stored bytes."""

    def values(media: bytes) -> tuple[str, int, str, str]:
        payload = read_png(media)
        return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), hashlib.sha256(media).hexdigest(), feature_of(payload)

    return _ranges(index, folder, None, values, ["payload_sha256", "tail_crc32", "media_sha256", "feature"], "payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Stores the payloads; the index with all metadata and feature columns, and the folder of its shards."""
    folder = new_path(docs.sparkSession, "media")
    index = store_payloads(docs, folder, id_col=id_col, text_col=text_col)
    places = materialize(manifest(index), "manifest")
    read = materialize(content_columns(header_columns(by_bytes(places), folder), folder), "media-columns")
    return index.select("doc_id", "n_bytes", "digest").join(read, "digest"), folder


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = media_columns(table(spark, sf_dir, "documents"))
    payload_bytes = F.col("width") * F.col("height") * F.col("bits") / 8
    return rows.select("doc_id", "n_bytes", payload_bytes.cast("long").alias("payload_bytes"), "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature")


QUERIES = {"op7_media_columns": op7_media_columns}
ORACLES: dict[str, str] = {}
