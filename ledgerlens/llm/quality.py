"""Quality by supervised subword embeddings.

Words, word pairs and character n-grams (case kept) have learned vectors in a
hashed table. A document is the mean of its vectors; a softmax on it gives the
class. Training is stochastic gradient descent in numpy. In scoring, a mean
followed by a linear layer is the mean of each vector's own output, so the
table is folded to one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import kernels
from ledgerlens.llm.common import arrow_job, held_out, labelled_sample, table

SIZES = (2, 3, 4)
BITS = 18
DIMENSIONS = 8
#: Bound of the training sample: labelled ids.
SAMPLE = 5_000
THRESHOLD = 0.3


@dataclass
class Model:
    #: Each bucket's share in the difference of the two classes' outputs.
    folded: np.ndarray
    bias: float


def _parts(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(lo, hi, [(buckets, first, end)]): each kind of feature of rows lo..hi, where each row's begin and end."""
    for lo, hi in kernels.chunks(at):
        begin, end = int(at[lo]), int(at[hi])
        code, first = kernels.characters(raw[begin:end], at[lo : hi + 1] - begin)
        kinds = [(ids, np.minimum(first[:-1], len(ids)), np.minimum(np.maximum(first[:-1], first[1:] - n + 1), len(ids))) for n, ids in kernels.gram_buckets(code, SIZES, BITS).items()]
        words, first = kernels.word_hashes(raw, at[lo : hi + 1])
        shift = np.uint64(64 - BITS)
        kinds.append(((words >> shift).astype(np.int32), first[:-1], first[1:]))
        if len(words) > 1:
            pairs = (kernels.mix(words[:-1] * np.uint64(3) + words[1:]) >> shift).astype(np.int32)
            kinds.append((pairs, np.minimum(first[:-1], len(pairs)), np.minimum(np.maximum(first[:-1], first[1:] - 1), len(pairs))))
        yield lo, hi, kinds


def train(texts: pa.ChunkedArray, y: np.ndarray, epochs: int = 6, rate: float = 0.5, seed: int = 5, keep: dict | None = None) -> Model:
    """Fits on labelled texts; with no texts, every score is one half. ``keep`` gets the layers."""
    rng = np.random.default_rng(seed)
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for chunk in texts.chunks:
        for lo, hi, kinds in _parts(*kernels.utf8(chunk)):
            for row in range(hi - lo):
                ids, times = np.unique(np.concatenate([k[a[row] : b[row]] for k, a, b in kinds]), return_counts=True)
                bags.append((ids, (times / max(1, times.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    if len(y) == 0:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    # Both classes weigh the same in all, so that a rare one is learned too.
    share = np.clip(np.array([(y == 0).mean(), (y == 1).mean()]), 0.02, 1)
    cost = 0.5 / share
    steps, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids, times = bags[i]
            now = rate * (1 - step / steps)
            step += 1
            rows = vectors[ids]
            mean = times @ rows
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= cost[y[i]] * now
            # The gradient of the mean goes to each vector by its share; a factor keeps pace with long texts.
            vectors[ids] = rows - np.outer(times * min(len(ids), 100), out.T @ p)
            out -= np.outer(p, mean)
            bias -= p
    if keep is not None:
        keep.update(vectors=vectors, out=out, bias=bias)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def _score(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    folded, bias = model.value.folded, model.value.bias
    for batch in batches:
        z = np.zeros(batch.num_rows)
        for lo, hi, kinds in _parts(*kernels.utf8(batch["text"])):
            total, n = np.zeros(hi - lo), np.zeros(hi - lo)
            for ids, first, end in kinds:
                sums = np.concatenate([[0.0], np.cumsum(folded[ids], dtype=np.float64)])
                total += sums[end] - sums[first]
                n += end - first
            z[lo:hi] = total / np.maximum(n, 1)
        p = 1 / (1 + np.exp(-np.clip(z + bias, -35, 35)))
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels.quality, from rows whose crc32(doc_id) modulo 5 is not 0; each id counts once."""
    rows = labelled_sample(docs, labels, "quality", 5, 0, sample)
    return train(rows["text"], rows["label"].to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts get the score of no features. Repeated rows each keep
    a row; a null id stays null and is not held out; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(5, 0).alias("held_out"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    return arrow_job(rows, partial(_score, model=shared, threshold=threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op5_subword_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
