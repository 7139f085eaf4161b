"""Packing by power-of-two decomposition: each document becomes pieces of binary length.

A document of n ids gives n // longest pieces of the longest length and one
piece for each set bit of the rest, long ones first. Every piece is a sequence
of its own, so no sequence crosses documents and none has padding; sequences
of one length share a bucket, and batches are filled within a bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe
from ledgerlens.llm.common import arrow_job, table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, batch long"
_ARROW = pa.schema([(n, pa.int32() if n == "bucket" else pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "batch")])


def piece_lengths(n: int, longest: int = 1024) -> list[int]:
    """Binary lengths that add up to n, none above ``longest`` (a power of two)."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def _pack(batches: Iterator[pa.RecordBatch], path: str | None, longest: int, end_id: int, batch_tokens: int) -> Iterator[pa.RecordBatch]:
    encode = bpe.encoder(path).encode
    task = TaskContext.get().partitionId() << 33
    sequence, filled = 0, [0] * longest.bit_length()
    end = np.array([end_id], dtype="<u4")
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            rows: list[tuple] = []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                start = 0
                for length in piece_lengths(len(ids), longest):
                    bucket = length.bit_length() - 1
                    number = filled[bucket] // max(1, batch_tokens // length)
                    rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), task + sequence, 0, bucket, task + (bucket << 28) + number))
                    filled[bucket] += 1
                    sequence += 1
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, longest: int = 1024, end_id: int = 0, batch_tokens: int = 65_536) -> DataFrame:
    """One row per piece: its place in the document, its checksum, its sequence, bucket and batch.

    A null or empty text is the end id alone. Repeated rows are packed each by
    themselves; extra columns are left out. A null id stays null. Work is one
    pass without a shuffle: sequence and batch numbers hold the task's number,
    so they are unique, and the same for the same input partitions.
    """
    work = partial(_pack, path=tokenizer, longest=longest, end_id=end_id, batch_tokens=batch_tokens)
    return arrow_job(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, SCHEMA)


def op8_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
