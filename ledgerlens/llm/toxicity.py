"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct character n-grams (A-Z lower-cased) it
has, hashed. Each is scaled by the log of how much more often toxic than other
training documents have it; those whose counts chance could explain are left
out. A logistic regression on the scaled features gives the score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import kernels
from ledgerlens.llm.common import arrow_job, held_out, labelled_sample, table

SIZES = (3, 4, 5, 6)
BITS = 20
#: Bound of the training sample: labelled ids.
SAMPLE = 8_000
#: Features whose likelihood ratio statistic against the label is lower aren't used.
SIGNIFICANT = 15.0
THRESHOLD = 0.7


@dataclass
class Model:
    #: Log-count ratio times weight of each bucket; 0 where a feature isn't used.
    weight: np.ndarray
    bias: float


def _grams(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, all n-gram buckets of the row, with repeats)."""
    for lo, hi in kernels.chunks(at):
        begin, end = int(at[lo]), int(at[hi])
        code, first = kernels.characters(kernels.LOWER[raw[begin:end]], at[lo : hi + 1] - begin)
        by_size = kernels.gram_buckets(code, SIZES, BITS)
        for row in range(lo, hi):
            a, b = first[row - lo], first[row - lo + 1]
            yield row, np.concatenate([by_size[n][a : max(a, b - n + 1)] for n in by_size] or [np.empty(0, np.int32)])


def _features(column: pa.Array | pa.ChunkedArray, keep: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The distinct buckets of each text; only those of ``keep`` where it is given."""
    place = np.zeros(1 << BITS, np.int32)
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for _, ids in _grams(*kernels.utf8(chunk)):
            yield kernels.once(ids if keep is None else ids[keep[ids]], place)


def document_counts(features: Iterable[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many toxic and other documents have each bucket."""
    counts = np.zeros((2, 1 << BITS))
    for ids, label in zip(features, y, strict=True):
        counts[int(label)][ids] += 1
    return counts[1], counts[0]


def log_count_ratios(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int, least: int = 3, prior: float = 1.0) -> np.ndarray:
    """Per bucket the log of its share in toxic over its share in other documents.

    Both shares are drawn towards the share in all documents by ``prior``
    documents; buckets of fewer than ``least`` documents get 0.
    """
    share = (c1 + c0) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log((c1 + prior * share) / (n1 + prior)) - np.log((c0 + prior * share) / (n0 + prior))
    return np.where(c1 + c0 >= least, np.nan_to_num(ratio), 0.0).astype(np.float32)


def significance(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Per bucket the likelihood ratio statistic of its presence against the label."""
    share = (c1 + c0) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda seen, expected: np.nan_to_num(seen * np.log(seen / expected))
        return 2 * (term(c1, n1 * share) + term(c0, n0 * share) + term(n1 - c1, n1 * (1 - share)) + term(n0 - c0, n0 * (1 - share)))


def logistic(features: list[np.ndarray], scale: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a class-balanced logistic regression, by full-batch Adam."""
    sizes = np.array([len(f) for f in features])
    ids = np.concatenate([*features, np.empty(0, np.int32)])
    used, place = np.unique(ids, return_inverse=True)
    rows = np.repeat(np.arange(len(y)), sizes)
    value = scale[ids].astype(np.float64)
    w, m, v = np.zeros(len(used) + 1), 0.0, 0.0
    cost = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, rounds + 1):
        z = np.bincount(rows, value * w[place], len(y)) + w[-1]
        error = cost * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        g = np.append(np.bincount(place, value * error[rows], len(used)) + decay * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weight = np.zeros(len(scale), np.float32)
    weight[used] = w[:-1] * scale[used]
    return weight, float(w[-1])


def train(texts: pa.ChunkedArray, y: np.ndarray, informative: float = 1.0) -> Model:
    """Fits on labelled texts; with one class only, every score is that class's."""
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0))
    # Texts are gone over twice, so that only the features that stay are held.
    c1, c0 = document_counts(_features(texts), y)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    scale = log_count_ratios(c1, c0, n1, n0)
    keep = (np.abs(scale) >= informative) & (significance(c1, c0, n1, n0) >= SIGNIFICANT)
    weight, bias = logistic(list(_features(texts, keep)), scale, y)
    return Model(weight, bias)


def _score(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    weight, bias = model.value.weight, model.value.bias
    place, used = np.zeros(1 << BITS, np.int32), weight != 0
    for batch in batches:
        z = np.full(batch.num_rows, bias)
        for row, ids in _grams(*kernels.utf8(batch["text"])):
            z[row] += weight[kernels.once(ids[used[ids]], place)].sum(dtype=np.float64)
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*(c for c in batch.schema.names if c != "text"), "score", "predicted"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels.toxic, from rows whose crc32(doc_id) modulo 3 is not 1; each id counts once."""
    rows = labelled_sample(docs, labels, "toxic", 3, 1, sample)
    return train(rows["text"], rows["label"].to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts get the score of no features. Repeated rows each keep
    a row; a null id stays null and is not held out; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(3, 1).alias("held_out"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    return arrow_job(rows, partial(_score, model=shared, threshold=threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")


def _clean(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scored = next(_score(iter([pa.RecordBatch.from_arrays([batch["text"]], ["text"])]), model, threshold))
        yield batch.filter(pa.compute.equal(scored["predicted"], 0))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all their columns; each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_job(docs, partial(_clean, model=shared, threshold=threshold), docs.schema)


def op10_naive_bayes_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
