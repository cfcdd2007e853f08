"""Content-addressed media columns: lossless images of texts in tar shards, read back by byte ranges."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, documents, materialize, new_path, small_side, sub_batches

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


@dataclass(frozen=True)
class MediaParams:
    """Payloads are padded by ``pad`` to a positive multiple of ``width`` and stored as 8-bit grey images of that width."""

    width: int = 576
    pad: int = 255
    level: int = 6
    shard_bytes: int = 256 << 20


def payload_of(text: str | None, params: MediaParams) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes([params.pad]) * (-len(data) % params.width or (0 if data else params.width))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, params: MediaParams) -> bytes:
    """An 8-bit grey PNG whose samples are the payload, row by row without filters."""
    rows = len(payload) // params.width
    lines = np.zeros((rows, params.width + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, params.width)
    head = struct.pack(">IIBBBBB", params.width, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), params.level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an unfiltered 8-bit grey PNG."""
    width, height, depth = png_header(data)
    at, parts = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if depth != 8 or lines[:, 0].any():
        raise ValueError("not an unfiltered 8-bit image")
    return lines[:, 1:].tobytes()


class _Shard:
    """A tar file being written; ``add`` returns the offset of a member's bytes."""

    def __init__(self, path: str):
        self.path = path
        self.files, where = fs.FileSystem.from_uri(path)
        self.out = self.files.open_output_stream(where)
        self.at = 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + bytes(-len(data) % 512))
        offset = self.at + len(head)
        self.at = offset + len(data) + (-len(data) % 512)
        return offset

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def _store(batches, folder: str, kind: str, params: MediaParams):
    """Every row's image, written to shards named by task, attempt and number, so that attempts never share a file."""
    task = TaskContext.get()
    name = f"{folder}/{kind}-{task.partitionId():06d}-{task.attemptNumber()}"
    shard, shards = None, 0
    for batch in sub_batches(batches):
        rows = []
        for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard is None or shard.at > params.shard_bytes:
                if shard is not None:
                    shard.close()
                shard, shards = _Shard(f"{name}-{shards:04d}.tar"), shards + 1
            image = to_png(payload_of(text, params), params)
            digest = hashlib.sha256(image).hexdigest()
            size = len((text or "").encode("utf-8", "surrogatepass"))
            rows.append((doc_id, key, size, digest, shard.path, shard.add(f"{digest}.png", image), len(image)))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STORED_TYPES, strict=True)], names=[c.split()[0] for c in _STORED.split(", ")]
            )
    if shard is not None:
        shard.close()


INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
_INDEX_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_STORED = INDEX.replace("doc_id long, ", "doc_id long, key binary, ")
_STORED_TYPES = [pa.int64(), pa.binary(), *_INDEX_TYPES[1:]]


def store(docs: DataFrame, params: MediaParams = MediaParams(), folder: str | None = None) -> DataFrame:
    """Store every row's text as an image in tar shards; returns the index ``(doc_id, n_bytes, digest, shard, offset, length)``.

    An image's address is its SHA-256, and equal texts are stored once and share one place. The digests of all texts
    are counted first: a text that stands once is written by the task that reads it, and the copies of another collapse by a
    partial aggregate before one of them is written. Shards are named by task and attempt, the same in every run; the
    index, which is written after them, names only those of attempts that ended well, so a lost executor costs a retry and
    leaves at most files that no row names (see :func:`remove_orphans`). The folder is in the shared folder unless given; it
    needs a scheme that ``pyarrow.fs`` can write.

    Null and empty texts become one row of padding bytes. An empty table writes nothing.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "media")
    files, where = fs.FileSystem.from_uri(folder)
    files.create_dir(where, recursive=True)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), text.alias("text"))
    copied = rows.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1").select("key", F.lit(True).alias("copied"))
    copied = small_side(materialize(copied, "copied"))
    written = lambda df, kind: materialize(df.mapInArrow(lambda it: _store(it, folder, kind, params), _STORED), "index")
    single = written(rows.join(copied, "key", "left_anti").select("doc_id", "key", "text"), "single")
    again = rows.join(copied, "key", "left_semi")
    one = again.groupBy("key").agg(F.first("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "key", "text")
    places = written(one.repartition("key").sortWithinPartitions("key"), "copied").drop("doc_id")
    names = [c.split()[0] for c in INDEX.split(", ")]
    shared = again.select("doc_id", "key").join(small_side(places), "key").select(*names)
    return materialize(single.select(*names).unionByName(shared), "index")


def remove_orphans(index: DataFrame, folder: str) -> int:
    """Delete shards that no row of the index names (left by failed attempts); returns how many."""
    named = {r[0].rsplit("/", 1)[1] for r in index.select("shard").distinct().toLocalIterator()}
    files, where = fs.FileSystem.from_uri(folder)
    lost = [f for f in files.get_file_info(fs.FileSelector(where)) if f.base_name.endswith(".tar") and f.base_name not in named]
    for f in lost:
        files.delete_file(f.path)
    return len(lost)


class _Reader:
    """Byte ranges of shards; the last shard stays open, and the task's end closes it."""

    def __init__(self):
        self.path, self.file = None, None

    def __enter__(self) -> _Reader:
        return self

    def __exit__(self, *error) -> None:
        if self.file is not None:
            self.file.close()
        self.path = self.file = None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.__exit__()
            files, where = fs.FileSystem.from_uri(path)
            self.path, self.file = path, files.open_input_file(where)
        return self.file.read_at(length, offset)


def _headers(batches, columns: int):
    with _Reader() as reader:
        for batch in sub_batches(batches):
            at = batch.schema.names.index
            places = zip(*(batch.column(at(c)).to_pylist() for c in ("shard", "offset")), strict=True)
            found = [png_header(reader.read(s, o, HEADER_BYTES)) for s, o in places]
            extra = [pa.array([f[i] for f in found], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], *extra], names=[*batch.schema.names, "width", "height", "depth"])


def with_headers(index: DataFrame) -> DataFrame:
    """Adds width, height and depth, read from each image's first 33 bytes; the payloads stay unread."""
    n = len(index.columns)
    return index.mapInArrow(lambda it: _headers(it, n), _ddl(index.schema.fields)[2:] + ", width int, height int, depth int")


def _features(payload: bytes) -> str:
    """Mean and deviation of the samples, share of padding-like rows, and an 8-bin histogram, in whole numbers."""
    samples = np.frombuffer(payload, np.uint8)
    n, total = len(samples), int(samples.sum(dtype=np.int64))
    squares = int((samples.astype(np.uint32) ** 2).sum(dtype=np.int64))
    spread = squares * n - total * total
    bins = np.bincount(samples >> 5, minlength=8)
    return f"mean_milli={total * 1000 // n};var_milli={spread * 1000 // (n * n)};hist=" + ",".join(map(str, bins))


OUT = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, shard string, offset long"
)


def _read_back(batches):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in OUT.split(", ")]
    with _Reader() as reader:

        def load(place):
            data = reader.read(*place)
            payload = from_png(data)
            return (
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data),
                hashlib.sha256(data).hexdigest(), _features(payload),
            )

        known = BoundedCache(load, 100_000)
        for batch in sub_batches(batches):
            rows = []
            for doc_id, n_bytes, digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True):
                found = known[shard, offset, length]
                if found[4] != digest:
                    raise ValueError(f"{shard} at {offset} doesn't hold {digest}")
                rows.append((doc_id, n_bytes, *found, shard, offset))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *batch.columns[6:]], names=[*names, *batch.schema.names[6:]])


def _ddl(fields) -> str:
    return "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)


def read_features(index: DataFrame) -> DataFrame:
    """Read every place of the index back, check its digest and compute digests and features of the payload.

    Each task reads a place once, however many rows of it name the place. Columns after the index's own stay.
    """
    head = len(_INDEX_TYPES)
    return index.mapInArrow(_read_back, OUT + _ddl(index.schema.fields[head:]))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every document's stored image; shard is the file's name in the media folder.

    Null and empty texts are one row of padding; equal texts have equal values, shard and offset included.
    """
    return read_features(with_headers(store(documents(spark, sf_dir)))).withColumn("shard", F.substring_index("shard", "/", -1))
