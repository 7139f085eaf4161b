"""Media columns: content-addressed payloads in tar shards.

A text's bytes, padded, become an 8-bit greyscale PNG. Each task writes one
tar shard and stores a payload once, under the digest of its bytes; rows carry
digest, shard, offset and length. Header-only range reads fill the metadata
columns, and full range reads give back the payload for features.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import kernels
from ledgerlens.llm.common import arrow_job, measured, shared_dir, table, written
from ledgerlens.llm.token_counts import filesystem

#: Pixels in a row; payloads are padded to whole rows, one at least.
WIDTH = 576
PAD = 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk, all that metadata needs.
HEADER_BYTES = 33
#: Bytes of stored payloads that one read task takes at most, in the mean.
STRIPE = 64 << 20


def pad(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A greyscale PNG whose samples are the payload."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample, from the first HEADER_BYTES bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", start[16:25])


def decode(media: bytes) -> bytes:
    """The samples of a PNG that ``encode`` made (unfiltered rows of 8-bit samples)."""
    width, height, _ = header(media)
    at, body = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Average hash of 64 stretches, mean and entropy of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    means = np.add.reduceat(samples.astype(np.int64), np.arange(64) * len(samples) // 64) / (len(samples) / 64)
    bits = int("".join("1" if m > means.mean() else "0" for m in means), 2)
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    return f"{bits:016x}-{samples.mean():.3f}-{-(share * np.log2(share)).sum():.3f}"


def _store(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    # A name of its own for each attempt: a repeated task never touches a shard that a manifest names.
    shard = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
    store, name = filesystem(shard)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    kept: dict[str, tuple[int, int]] = {}
    at = 0
    with store.open_output_stream(name) as out:
        for batch in batches:
            raw, offsets = kernels.utf8(batch["text"])
            rows = []
            for i in range(batch.num_rows):
                data = raw[offsets[i] : offsets[i + 1]].tobytes()
                payload = pad(data)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in kept:
                    media = encode(payload)
                    entry = tarfile.TarInfo(f"{digest}.png")
                    entry.size = len(media)
                    head = entry.tobuf(tarfile.GNU_FORMAT)
                    out.write(head + media + bytes(-len(media) % 512))
                    kept[digest] = (at + len(head), len(media))
                    at += len(head) + len(media) + -len(media) % 512
                rows.append((len(data), len(payload), digest, shard, *kept[digest]))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)] if rows else None
            if columns:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        out.write(bytes(1024))


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes tar shards below ``folder``; returns rows (doc_id, n_bytes, payload_bytes, digest, shard, offset, length).

    Null and empty texts are one row of padding. Equal payloads of a task are
    stored once, and ``catalogue`` gives each digest one address. The rows are
    written before they are returned, so shards are made once; shards of failed
    attempts are in no row. Other columns are left out.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = arrow_job(docs.select("doc_id", "text"), partial(_store, folder=folder), f"doc_id {kind}, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long")
    return written(rows, "media-rows")


def catalogue(rows: DataFrame) -> DataFrame:
    """One address (shard, offset, length) for each digest."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a")).select("digest", "a.shard", "a.offset", "a.length")


def _ranges(batch: pa.RecordBatch, most: int | None = None) -> Iterator[bytes]:
    opened, f = None, None
    for shard, offset, length in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True):
        if shard != opened:
            if f is not None:
                f.close()
            where, name = filesystem(shard)
            opened, f = shard, where.open_input_file(name)
        f.seek(offset)
        yield f.read(length if most is None else min(most, length))
    if f is not None:
        f.close()


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [header(start) for start in _ranges(batch, HEADER_BYTES)]
        width, height, depth = (pa.array([h[i] for h in found], pa.int32()) for i in range(3))
        yield pa.RecordBatch.from_arrays([*batch.columns, width, height, depth], [*batch.schema.names, "width", "height", "depth"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in _ranges(batch):
            payload = decode(media)
            rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read(addresses: DataFrame, total: int | None = None) -> DataFrame:
    """The catalogue with metadata from headers (width, height, depth) and digests and features of the stored bytes.

    Tasks take ranges of shards, so a large shard is read by several. Their
    number follows from the bytes to be read, not from the few of the catalogue.
    """
    total = total if total is not None else addresses.agg(F.sum("length")).first()[0] or 0
    tasks = max(4 * addresses.sparkSession.sparkContext.defaultParallelism, -(-total // STRIPE))
    placed = addresses.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    base = "digest string, shard string, offset long, length long"
    with_headers = arrow_job(placed.select("digest", "shard", "offset", "length"), _headers, f"{base}, width int, height int, depth int")
    return arrow_job(with_headers, _contents, f"{base}, width int, height int, depth int, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height) of every row.

    Texts are stored in ``folder`` and read back from there. Null and empty
    texts are one row of padding; repeated rows each keep a row; a null id
    stays null; other columns are left out; an empty table gives no rows.
    """
    rows = store(docs, folder)
    addresses, seen = measured(catalogue(rows), "media-catalogue", total=F.coalesce(F.sum("length"), F.lit(0)))
    found = read(addresses, seen["total"]).select("digest", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
    return rows.join(found, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op6_tar_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), shared_dir(spark, "media"))
