"""Media columns: content-addressed payloads in tar shards.

A payload is stored once as a losslessly compressed 8-bit grey image (PNG, 576
samples wide), named by the digest of its payload. Of texts that occur several
times, which a count of their digests tells beforehand, the row of least doc_id
stores the payload. Each task writes tar shards of bounded size to the shared folder
and returns, for each row, the digest and, where stored, the shard, the offset and
the length. Rows of equal digest are then led to one location, the first by (shard,
offset); payloads themselves are not shuffled while the list of copies is short
enough to be broadcast. Only copies that share a doc_id, too, can be stored twice.

A shard's name is a digest of its content, and it appears by a rename once
complete: a repeated task finds or writes the same file again, and a lost one leaves
no half shard under a name that rows refer to.

Metadata columns are filled by range reads of the image headers alone.
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

from ._common import map_texts, shared_dir, small, stored, text_slices, utf8

WIDTH = 576
PAD = b"\xff"
#: Bytes of a shard at which it is closed.
SHARD_BYTES = 32 << 20
#: Rows, of stored payloads and copies, that one shard answers for at most.
SHARD_ROWS = 100_000
#: PNG signature, IHDR chunk and the length and type of the next chunk's start: all that metadata needs.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 3


def payload(raw: bytes) -> bytes:
    """The bytes, filled up with 255 to a positive multiple of WIDTH."""
    return raw + PAD * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """An 8-bit grey image of the samples, WIDTH to a row, without row filters."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits per sample) from the first HEADER_BYTES."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png made; checks the chunks' checksums."""
    width, height, _ = png_header(data)
    at, packed = HEADER_BYTES, b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk is damaged")
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation, entropy of the values and mean step between neighbours."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    share = count[count > 0] / len(x)
    value = np.arange(256)
    mean = float((count * value).sum() / len(x))
    deviation = float((count * (value - mean) ** 2).sum() / len(x)) ** 0.5
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"mean={mean:.4f};std={deviation:.4f};entropy={abs(float(-(share * np.log2(share)).sum())):.4f};step={step:.4f}"


class _Shard:
    """A tar file in memory, of bounded size unless one payload is larger."""

    def __init__(self, folder: str):
        self.files, self.path = fs.FileSystem.from_uri(folder)
        self.clear()

    def clear(self) -> None:
        self.buffer = io.BytesIO()
        self.tar = tarfile.open(fileobj=self.buffer, mode="w", format=tarfile.GNU_FORMAT)
        self.place: dict[bytes, tuple[int, int]] = {}

    def add(self, digest: bytes, samples: bytes) -> None:
        media = to_png(samples)
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(media)
        self.tar.addfile(info, io.BytesIO(media))
        self.place[digest] = (self.buffer.tell() - -(-len(media) // 512) * 512, len(media))

    def close(self) -> str:
        """Writes the shard; its name."""
        self.tar.close()
        data = self.buffer.getbuffer()
        name = f"shard-{hashlib.sha256(data).hexdigest()[:32]}.tar"
        draft = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        there = lambda: self.files.get_file_info(f"{self.path}/{name}").size == len(data)
        if there():
            return name
        with self.files.open_output_stream(draft) as out:
            out.write(data)
        try:
            self.files.move(draft, f"{self.path}/{name}")
        except OSError:
            # Another attempt of this task came first, where a rename replaces nothing.
            if not there():
                raise
            self.files.delete_file(draft)
        return name


def copies(docs: DataFrame) -> DataFrame:
    """(sha, owner): digests of the texts that occur several times, with the least doc_id."""
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.groupBy(sha.alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")).filter("n > 1").select("sha", "owner")


def write_shards(docs: DataFrame, folder: str, repeated: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, digest, shard, offset, length) per row of
    ``docs``; each task writes its payloads' shards to ``folder``. A row whose text is
    among the stored ``repeated`` (sha, owner) and whose doc_id isn't the owner's writes
    nothing; its shard, offset and length are null. Evaluate once, by storing the result."""
    names = ["doc_id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []

        def done() -> pa.RecordBatch:
            name = shard.close() if shard.place else None
            ids, sizes, padded, digests, keeps = zip(*rows)
            at = [shard.place.get(d) if k else None for d, k in zip(digests, keeps)]
            cols = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(padded, pa.int64()), pa.array(digests, pa.binary()), pa.array([name if p else None for p in at], pa.string()), *(pa.array([p and p[i] for p in at], pa.int64()) for i in range(2))]
            shard.clear()
            rows.clear()
            return pa.record_batch(cols, names=names)

        for part in text_slices(batches):
            shard = shard or _Shard(folder)
            for doc_id, raw, keep in zip(part.column(0).to_pylist(), utf8(part.column(1)), part.column(2).to_pylist()):
                samples = payload(raw)
                digest = hashlib.sha256(samples).digest()
                if keep and digest not in shard.place:
                    shard.add(digest, samples)
                rows.append((doc_id, len(raw), len(samples), digest, keep))
                if shard.buffer.tell() >= SHARD_BYTES or len(rows) >= SHARD_ROWS:
                    yield done()
        if rows:
            yield done()

    if repeated is None:
        marked = docs.select("doc_id", "text", F.lit(True).alias("keep"))
    else:
        sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
        keep = F.col("owner").isNull() | F.col("doc_id").eqNullSafe(F.col("owner"))
        marked = docs.select("doc_id", "text", sha.alias("sha")).join(small(repeated, repeated.count()), "sha", "left").select("doc_id", "text", keep.alias("keep"))
    return map_texts(marked, write, "doc_id long, n_bytes long, payload_bytes long, digest binary, shard string, offset long, length long")


def _ranges(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, pa.NativeFile]]]]:
    """Each batch with (offset, length, open shard) of its rows, which come sorted by shard."""
    files, path = fs.FileSystem.from_uri(folder)
    name, shard = None, None
    for batch in batches:
        made = []
        for s, o, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if s != name:
                name, shard = s, files.open_input_file(f"{path}/{s}")
            made.append((o, n, shard))
        yield batch, made


def _by_shard(places: DataFrame) -> DataFrame:
    """``places`` (digest, shard, offset, length), range-dealt so that each task reads runs of a shard."""
    shards = places.select("shard").distinct().count()
    return places.select("shard", "offset", "length", "digest").repartitionByRange(max(1, shards), "shard", "offset").sortWithinPartitions("shard", "offset")


def read_headers(places: DataFrame, folder: str) -> DataFrame:
    """Metadata columns (digest, width, height, bits) from header-only range reads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ranges in _ranges(folder, batches):
            heads = [png_header(shard.read_at(HEADER_BYTES, o)) for o, _, shard in ranges]
            yield pa.record_batch([batch.column(3), *(pa.array([h[i] for h in heads], pa.int32()) for i in range(3))], names=["digest", "width", "height", "bits"])

    return _by_shard(places).mapInArrow(read, "digest binary, width int, height int, bits int")


def read_payloads(places: DataFrame, folder: str) -> DataFrame:
    """(digest, shard, offset, media_bytes, payload_sha256, tail_crc32, media_sha256,
    feature) from the stored bytes."""
    schema = "digest binary, shard string, offset long, media_bytes long, payload_sha256 binary, tail_crc32 long, media_sha256 binary, feature string"
    types = (pa.binary(), pa.int64(), pa.binary(), pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ranges in _ranges(folder, batches):
            rows = []
            for o, n, shard in ranges:
                media = shard.read_at(n, o)
                samples = from_png(media)
                rows.append((hashlib.sha256(samples).digest(), zlib.crc32(samples[-32:]), hashlib.sha256(media).digest(), features(samples)))
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.record_batch([*(batch.column(k) for k in (3, 0, 1, 2)), *(pa.array(c, t) for c, t in zip(cols, types))], names=[f.split()[0] for f in schema.split(", ")])

    return _by_shard(places).mapInArrow(read, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, payload_bytes, the location (shard,
    offset, media_bytes), from header-only range reads width, height and bits, and from
    the stored bytes, read back: payload_sha256, tail_crc32, media_sha256, feature
    (digests in hex). Null text is empty; an empty payload is one row of 255; equal
    texts share one location. An empty table writes nothing and gives no rows."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(files)
    rows = stored(write_shards(docs, folder, stored(copies(docs), "media-copies")), "media-rows")
    places = rows.filter("shard is not null").groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"))
    first = stored(places.select("digest", "p.*"), "media-places")
    read = stored(read_payloads(first, folder).join(read_headers(first, folder), "digest"), "media-read")
    found = rows.select("doc_id", "n_bytes", "payload_bytes", "digest").join(read, "digest")
    return found.select("doc_id", "n_bytes", "payload_bytes", "shard", "offset", "media_bytes", "width", "height", "bits", F.lower(F.hex("payload_sha256")).alias("payload_sha256"), "tail_crc32", F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature")
