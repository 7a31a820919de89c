"""Media columns: content-addressed images in tar shards, filled from ranges of the shards."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, documents_of, text_slices
from tessera.sources.cut import cut, shared_folder

UNIT = 64
SHARD_BYTES = 64 << 20
HEADER_BYTES = 33
MAGIC = b"\x89PNG\r\n\x1a\n"
STORED = "doc_id long, n_bytes long, digest binary, shard string, place long, media_bytes long"
MEASURED = "digest binary, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 binary, feature string, width int, height int, shard string, place long"


def payload_of(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of UNIT."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes) -> bytes:
    """A PNG of 8-bit grey samples, UNIT wide, one sample per byte of the payload."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    raw = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()
    header = struct.pack(">IIBBBBB", UNIT, len(lines), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def image_size(header: bytes) -> tuple[int, int]:
    """Width and height from the first HEADER_BYTES of an image."""
    if header[:8] != MAGIC or header[12:16] != b"IHDR" or zlib.crc32(header[12:29]) != struct.unpack(">I", header[29:33])[0]:
        raise ValueError("not an image")
    return struct.unpack(">II", header[16:24])


def decode_image(media: bytes) -> bytes:
    """The samples of an image made by `encode_image`; each chunk's checksum is tested."""
    width, height = image_size(media[:HEADER_BYTES])
    at, data = 8, []
    while at < len(media):
        length, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + length]
        if zlib.crc32(media[at + 4 : at + 8 + length]) != struct.unpack(">I", media[at + 8 + length : at + 12 + length])[0]:
            raise ValueError("a damaged image")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + length
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return raw[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Height, mean, spread and a 16-bin histogram in 255ths, as text."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 255 // len(x)
    return f"{len(x) // UNIT}:{x.mean():.4f}:{x.std():.4f}:{bytes(bins.astype(np.uint8)).hex()}"


def _store(folder: str) -> tuple:
    """The file system of a folder and the folder's path in it; works for any store pyarrow can open."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return system, path.rstrip("/")


class _Shard:
    """A tar file in the making: members by digest, each once."""

    def __init__(self):
        self.buffer, self.members, self.rows = io.BytesIO(), {}, []

    def add(self, digest: bytes, media: bytes) -> tuple[int, int]:
        if digest not in self.members:
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(media)
            self.buffer.write(info.tobuf())
            self.members[digest] = (self.buffer.tell(), len(media))
            self.buffer.write(media + b"\0" * (-len(media) % tarfile.BLOCKSIZE))
        return self.members[digest]

    def write(self, folder: str) -> str:
        """Puts the shard under a name made from its content; a repeated task writes the same file again."""
        name = f"{hashlib.sha256(b''.join(self.members)).hexdigest()[:24]}.tar"
        system, path = _store(folder)
        system.create_dir(path, recursive=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(self.buffer.getbuffer())
            out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
        system.move(part, f"{path}/{name}")
        return name


def store_media(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes every text's image into tar shards in `folder` (one all executors reach): a row with digest, name of the
    shard, place and length for each document. A shard holds each content once; texts are not shuffled for that."""

    def stored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()

        def closed() -> Iterator[pa.RecordBatch]:
            if shard.rows:
                path = shard.write(folder)
                ids, sizes, digests, places, lengths = zip(*shard.rows, strict=True)
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([path] * len(ids)), pa.array(places, pa.int64()), pa.array(lengths, pa.int64())],
                    names=["doc_id", "n_bytes", "digest", "shard", "place", "media_bytes"],
                )

        for batch in text_slices(batches):
            for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").cast(pa.large_binary()).to_pylist(), strict=True):
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                at = shard.members.get(digest) or shard.add(digest, encode_image(payload))
                shard.rows.append((doc, len(text), digest, *at))
                if shard.buffer.tell() >= shard_bytes:
                    yield from closed()
                    shard = _Shard()
        yield from closed()

    return documents_of(docs).mapInArrow(stored, STORED)


def image_sizes(members: DataFrame, folder: str) -> DataFrame:
    """`digest, width, height` of stored images: only HEADER_BYTES of each are read."""

    def headers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [image_size(header) for header, _ in _members(batch, folder)]
            yield pa.record_batch([column(batch, "digest"), pa.array([w for w, _ in found], pa.int32()), pa.array([h for _, h in found], pa.int32())], names=["digest", "width", "height"])

    return members.select("digest", "shard", "place", "media_bytes").mapInArrow(headers, "digest binary, width int, height int")


def _members(batch: pa.RecordBatch, folder: str) -> Iterator[tuple[bytes, Callable[[], bytes]]]:
    """The header of each row's member, and a function that reads the rest; a shard stays open for the rows that follow."""
    now, source = None, None
    try:
        for shard, place, length in zip(*(column(batch, c).to_pylist() for c in ("shard", "place", "media_bytes")), strict=True):
            if shard != now:
                if source:
                    source.close()
                system, path = _store(f"{folder.rstrip('/')}/{shard}")
                now, source = shard, system.open_input_file(path)
            head = min(length, HEADER_BYTES)
            yield source.read_at(head, place), partial(source.read_at, length - head, place + head)
    finally:
        if source:
            source.close()


def measure(members: DataFrame, folder: str) -> DataFrame:
    """Columns of the stored images, see MEASURED: sizes from a range read of the header, the others from the rest."""

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, shard, place, (header, rest) in zip(*(column(batch, c).to_pylist() for c in ("digest", "shard", "place")), _members(batch, folder), strict=True):
                size, media = image_size(header), header + rest()
                payload = decode_image(media)
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError("the stored bytes are not those of their digest")
                rows.append((digest, len(payload), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).digest(), feature_of(payload), *size, shard, place))
            names, types = zip(*(c.split() for c in MEASURED.split(", ")), strict=True)
            kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
            yield pa.record_batch([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=list(names))

    return members.select("digest", "shard", "place", "media_bytes").mapInArrow(measured, MEASURED)


def media_columns(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every document's media row: `doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, width, height, shard, place`.

    Texts are stored in `folder` (by default one in the folder that spark.checkpoint.dir names). Contents are known
    by digest: of one content's places the first is used by all its documents, read and measured once.

    A null or empty text is one line of zeros. Rows without a doc_id are left out, repeated rows each get a row, an
    empty table gives no rows, other columns are not read.
    """
    if folder is None:
        folder = f"{shared_folder(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    stored = cut(store_media(docs, folder, shard_bytes))
    first = stored.groupBy("digest").agg(F.min(F.struct("shard", "place", "media_bytes")).alias("at")).select("digest", "at.*")
    members = first.repartition(F.col("shard"), F.pmod(F.xxhash64("digest"), F.lit(16))).sortWithinPartitions("shard", "place")
    rows = stored.select("doc_id", "n_bytes", "digest").join(measure(members, folder), "digest")
    hexed = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", hexed("digest").alias("payload_sha256"), "tail_crc32", "media_bytes", hexed("media_sha256").alias("media_sha256"),
        "feature", "width", "height", F.concat(F.lit(f"{folder.rstrip('/')}/"), "shard").alias("shard"), "place",
    )
