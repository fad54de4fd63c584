"""Media payloads in content-addressed tar shards.

Each document's payload (its UTF-8 bytes, padded with zeros to a positive multiple of 64) is stored as a grey PNG, 64 samples
of 8 bits a row. Every task writes tar shards of its own in the shared folder; a member is named by the SHA-256 of its bytes
and stored once per shard, and rows carry only digest, shard, offset and length. A task that is run again writes new shards,
so rows never point at a half-written one (the shards of lost attempts stay until the folder goes). Equal payloads of different
tasks are stored by each of them: digests are equal, places are not. Metadata columns come from a range read of the PNG's header alone; features come
from a second range read of the whole member.
"""

from __future__ import annotations

import hashlib
import io
import math
import os
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch

WIDTH = 64
SHARD_BYTES = 256 << 20
#: Bytes that a reading task is meant to fetch, and of a shard that go to one task together.
TASK_BYTES, TOGETHER = 64 << 20, 8 << 20
#: Fixed values of the PNG format: signature, bytes before the first chunk's end, and samples of 8-bit grey.
PNG_SIGNATURE, PNG_HEADER, GREY_8 = b"\x89PNG\r\n\x1a\n", 33, (8, 0)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), *GREY_8, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits and colour kind from a PNG's first bytes."""
    if head[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    at, parts = 8, []
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, WIDTH + 1)
    return rows[:, 1:].tobytes()


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Shards:
    """Tar shards of one task; ``add`` gives the place of a payload's bytes."""

    def __init__(self, folder: str):
        self.folder, self.out, self.places = folder, None, {}

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        if digest not in self.places:
            if self.out is None or self.at > SHARD_BYTES:
                self.close()
                self.name = f"{self.folder}/shard-{uuid.uuid4().hex}.tar"
                store, path = file_system(self.name)
                store.create_dir(os.path.dirname(path), recursive=True)
                self.out, self.at = store.open_output_stream(path), 0
            entry = tarfile.TarInfo(f"{digest}.png")
            entry.size = len(data)
            head = entry.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + bytes(-len(data) % tarfile.BLOCKSIZE))
            self.places[digest] = (self.name, self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % tarfile.BLOCKSIZE
        return self.places[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out, self.places = None, {}


def store(docs: DataFrame, text: str = "text", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Write all payloads; per row: key, n_bytes, digest, shard, offset, length. Written to a table, so it runs once."""
    folder = folder or scratch(docs.sparkSession, "media")

    @F.pandas_udf("n_bytes long, digest string, shard string, offset long, length long")
    def write(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shards = Shards(folder)
        for batch in batches:
            out = []
            for t in batch:
                data = to_png(payload_of(t))
                digest = hashlib.sha256(data).hexdigest()
                out.append((len((t or "").encode()), digest, *shards.add(digest, data)))
            yield pd.DataFrame(out, columns=["n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return materialise(docs.select(F.col(key).alias("id"), write(F.col(text)).alias("at")).select("id", "at.*"), "media-rows")


def dealt_by_bytes(rows: DataFrame) -> DataFrame:
    """Rows dealt by the bytes that they point at, in the order of their places: neighbours in a shard are read together.

    The rows themselves are small, so without this the number of reading tasks would follow their table's few files.
    """
    total = rows.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES))
    return rows.repartition(tasks, "shard", F.expr(f"offset div {TOGETHER}")).sortWithinPartitions("shard", "offset")


class Reader:
    """Range reads of shards; the last one stays open."""

    def __init__(self):
        self.name = None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            where, path = file_system(shard)
            self.file, self.name = where.open_input_file(path), shard
        return self.file.read_at(length, offset)


def metadata(rows: DataFrame) -> DataFrame:
    """Rows with ``width`` and ``height`` from the first bytes of each member; the samples aren't read."""

    @F.pandas_udf("width int, height int")
    def head(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for shard, offset in batches:
            yield pd.DataFrame([png_header(reader.read(s, o, PNG_HEADER))[:2] for s, o in zip(shard, offset)], columns=["width", "height"])

    return rows.withColumn("head", head("shard", "offset")).select("*", "head.*").drop("head")


def features_of(payload: bytes, width: int, height: int) -> str:
    samples = np.frombuffer(payload, np.uint8)
    return f"{width}x{height}x8 mean={samples.mean():.4f} std={samples.std():.4f} values={np.count_nonzero(np.bincount(samples, minlength=256))}"


def features(rows: DataFrame) -> DataFrame:
    """Rows with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, from the stored bytes.

    A member that doesn't match its digest or header raises an error.
    """

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def read(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        reader, known = Reader(), OrderedDict()  # the last few results, for copies
        for batch in batches:
            out = []
            for digest, shard, offset, length, width, height in zip(*batch):
                if digest not in known:
                    data = reader.read(shard, offset, length)
                    payload, media = from_png(data), hashlib.sha256(data).hexdigest()
                    if media != digest or len(payload) != width * height:
                        raise ValueError(f"{shard} is damaged at {offset}")
                    known[digest] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), media, features_of(payload, width, height))
                    if len(known) > 1000:
                        known.popitem(last=False)
                out.append(known[digest])
            yield pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return rows.withColumn("read", read("digest", "shard", "offset", "length", "width", "height")).select("*", "read.*").drop("read")


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Per row: key, n_bytes, digest, shard, offset, length, width, height and the features.

    Null and empty texts are 64 zeros; equal texts have equal digests and features; repeated rows point at one member of
    their shard; an empty table gives no rows; other columns are left out.
    """
    return features(metadata(dealt_by_bytes(store(docs, text, key, folder)))).withColumnRenamed("id", key)


def read_tar(data: bytes) -> dict[str, bytes]:
    """All members of a shard, as any tar reader sees them."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
