"""Token counts of flat, unindexed token files, found by a scan for the end-of-document id.

Documents are written as runs of fixed-width ids, each closed by a separator,
with nothing that tells where one begins. The scan cuts the files into blocks,
finds separators in each block by one vectorised comparison, and stitches
documents that cross blocks with a prefix scan over the blocks of a file: a
running sum numbers the separators, a running maximum gives the last one
before each block. Only those two numbers of a block take part in the scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import bpe
from ledgerlens.llm.common import arrow_job, shared_dir, table, written

#: <|endoftext|>, which ordinary text never encodes to.
SEPARATOR = 50_256
#: Ids per block: 2 MB of 16-bit ids.
BLOCK = 1 << 20
#: Bytes of token files that a task scans, at most.
SCANNED = 64 << 20


def scan_tasks(n_bytes: int, parallelism: int) -> int:
    """Tasks of a scan: four for each core, or more where they would scan more than SCANNED bytes."""
    return max(4 * parallelism, -(-n_bytes // SCANNED))


def filesystem(uri: str):
    """The file system and path of a URI (file, hdfs, s3, ...), open to executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str | None, separator: int, width: int) -> Iterator[pa.RecordBatch]:
    # A name of its own for each attempt: a repeated task never touches a file that a manifest names.
    path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
    encode, end = bpe.encoder(tokenizer, ordinary=True).encode, np.array([separator], f"<u{width}")
    store, name = filesystem(path)
    ordinal = 0
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as out:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                for text in part["text"]:
                    out.write(encode(text.as_py() or "").astype(end.dtype).tobytes() + end.tobytes())
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * part.num_rows), "ordinal": pa.array(range(ordinal, ordinal + part.num_rows), pa.int64()), "doc_id": part["doc_id"].cast(pa.int64())})
                ordinal += part.num_rows


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """Writes one flat file per task below ``folder``; returns the manifest (path, ordinal, doc_id).

    Files are of little-endian unsigned ids of ``width`` bytes. The string of
    a special token is encoded as ordinary text, so that the separator stands
    only where a document ends. A null text is an empty document. The manifest is written before it is returned, so the
    files are made once; files of failed attempts are not in it.
    """
    work = partial(_write, folder=folder, tokenizer=tokenizer, separator=separator, width=width)
    rows = arrow_job(docs.select(F.col("doc_id").cast("long"), "text"), work, "path string, ordinal long, doc_id long")
    return written(rows, "token-manifest")


def _sizes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch["path"].to_pylist():
            store, name = filesystem(path)
            found.append(store.get_file_info(name).size // width)
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array(found, pa.int64())], ["path", "size"])


def sizes(paths: DataFrame, width: int = 2) -> DataFrame:
    """(path, size): how many ids each file holds, as the file system tells."""
    return arrow_job(paths.where("path is not null").select("path").distinct(), partial(_sizes, width=width), "path string, size long")


def _scan(batches: Iterator[pa.RecordBatch], separator: int, width: int, block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, number, size in zip(batch["path"].to_pylist(), batch["block"].to_pylist(), batch["size"].to_pylist(), strict=True):
            store, name = filesystem(path)
            with store.open_input_file(name) as f:
                f.seek(number * block * width)
                ids = np.frombuffer(f.read(min(block, size - number * block) * width), f"<u{width}")
            ends = np.flatnonzero(ids == separator) + number * block
            yield pa.RecordBatch.from_pydict({"path": [path], "block": pa.array([number], pa.int64()), "size": pa.array([size], pa.int64()), "ends": pa.array([ends.astype(np.int64)], pa.list_(pa.int64()))})


def scan_token_files(files: DataFrame, separator: int = SEPARATOR, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(path, ordinal, start, n_tokens, closed) of every document in the files (path, size in ids).

    Two separators in a row enclose a document of 0 ids. Ids after the last
    separator are a document with ``closed`` false; a file that ends with a
    separator has none, and an empty file has no documents. Null paths are
    left out. What the blocks hold is written once; the prefix scan sees two
    numbers a block, so a file of a terabyte is half a million rows of it.
    """
    files = files.where("path is not null and size > 0").select("path", F.col("size").cast("long"))
    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))))
    work = partial(_scan, separator=separator, width=width, block=block)
    # A number of tasks from the files' sizes: rows of blocks are so short that adaptive execution would put them all into one task.
    ids = files.agg(F.sum("size")).first()[0] or 0
    blocks = blocks.repartition(scan_tasks(ids * width, files.sparkSession.sparkContext.defaultParallelism), "path", "block")
    found = written(arrow_job(blocks, work, "path string, block long, size long, ends array<long>"), "token-blocks")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    few = found.select("path", "block", F.size("ends").alias("n"), F.expr("try_element_at(ends, -1)").alias("end"))
    carried = few.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal0"), F.coalesce(F.max("end").over(before), F.lit(-1)).alias("previous"))
    last = F.floor((F.col("size") - 1) / block) == F.col("block")
    stitched = (
        found.join(carried, ["path", "block"])
        .withColumn("last_end", F.coalesce(F.expr("try_element_at(ends, -1)"), F.col("previous")))
        .withColumn("closed_docs", F.transform("ends", lambda e, i: F.struct((F.col("ordinal0") + i).alias("ordinal"), F.when(i == 0, F.col("previous")).otherwise(F.get("ends", i - 1)).alias("after"), e.alias("end"), F.lit(True).alias("closed"))))
    )
    open_end = last & (F.col("last_end") < F.col("size") - 1)
    tail = F.array(F.struct((F.col("ordinal0") + F.size("ends")).alias("ordinal"), F.col("last_end").alias("after"), F.col("size").alias("end"), F.lit(False).alias("closed")))
    docs = stitched.select("path", F.explode(F.when(open_end, F.concat("closed_docs", tail)).otherwise(F.col("closed_docs"))).alias("d"))
    return docs.select("path", "d.ordinal", (F.col("d.after") + 1).alias("start"), (F.col("d.end") - F.col("d.after") - 1).alias("n_tokens"), "d.closed")


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row, through token files in the shared folder.

    Null and empty texts count 0; repeated rows and ids each keep their row;
    other columns are left out.
    """
    manifest = write_token_files(docs, shared_dir(docs.sparkSession, "token-files"), tokenizer)
    counts = scan_token_files(written(sizes(manifest), "token-sizes"))
    # Both sides grow with the documents: neither is ever broadcast.
    return manifest.join(counts.hint("merge"), ["path", "ordinal"]).select("doc_id", "n_tokens")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
