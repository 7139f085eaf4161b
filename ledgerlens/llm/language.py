"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (n from 1 to 4,
hashed, A-Z lower-cased) that both have, over the geometric mean of how many
each has. Landmarks of each language span a Nyström map; one-versus-rest
kernel ridge regression is solved on it. Scoring multiplies the presence
matrix of a batch with one matrix: landmarks, map and regression folded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import kernels
from ledgerlens.llm.common import arrow_job, held_out, sample_of, table

SIZES = (1, 2, 3, 4)
BITS = 16
#: Bounds of the training sample: ids and landmarks of each language.
SAMPLE, LANDMARKS = 750, 48
#: Languages that are learned at most, the commonest of them; and ids and landmarks of all together, dealt out evenly where they are many.
LANGUAGES, ALL_SAMPLE, ALL_LANDMARKS = 100, 24_000, 1000
RIDGE = 1e-2


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    #: Buckets by languages.
    folded: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))


def _presence(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct n-gram buckets)."""
    place = np.zeros(1 << BITS, np.int32)
    for lo, hi in kernels.chunks(at):
        begin, end = int(at[lo]), int(at[hi])
        code, first = kernels.characters(kernels.LOWER[raw[begin:end]], at[lo : hi + 1] - begin)
        by_size = kernels.gram_buckets(code, SIZES, BITS)
        for row in range(lo, hi):
            a, b = first[row - lo], first[row - lo + 1]
            yield row, kernels.once(np.concatenate([by_size[n][a : max(a, b - n + 1)] for n in by_size] or [np.empty(0, np.int32)]), place)


def train(texts: list[np.ndarray], languages: list[str]) -> Model:
    """Fits on the distinct buckets of texts and their languages."""
    names = sorted(set(languages))
    if not names:
        return Model()
    y = np.array([names.index(x) for x in languages])
    each = min(LANDMARKS, ALL_LANDMARKS // len(names))
    landmarks = np.concatenate([np.flatnonzero(y == c)[:each] for c in range(len(names))])
    spread = np.zeros((1 << BITS, len(landmarks)), np.float32)
    for j, i in enumerate(landmarks):
        spread[texts[i], j] = 1 / np.sqrt(max(1, len(texts[i])))
    kernel = np.stack([spread[ids].sum(axis=0) / np.sqrt(max(1, len(ids))) for ids in texts]).astype(np.float64)
    values, axes = np.linalg.eigh(kernel[landmarks] + 1e-6 * np.eye(len(landmarks)))
    root = axes / np.sqrt(np.maximum(values, 1e-6)) @ axes.T
    mapped = kernel @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    # Languages weigh the same in all.
    weight = (len(y) / len(names) / np.bincount(y, minlength=len(names)))[y][:, None]
    solved = np.linalg.solve(mapped.T @ (weight * mapped) + RIDGE * len(y) * np.eye(len(landmarks)) / len(landmarks), mapped.T @ (weight * target))
    return Model(names, (spread @ (root @ solved)).astype(np.float32))


def _choose(text: pa.Array, lettered: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language as an index, -1 for none, and its score."""
    chosen, scores = np.full(len(text), -1), np.zeros(len(text))
    if model.languages:
        for row, ids in _presence(*kernels.utf8(text)):
            if lettered[row]:
                out = model.folded[ids].sum(axis=0, dtype=np.float64) / np.sqrt(max(1, len(ids)))
                chosen[row] = out.argmax()
                scores[row] = min(1.0, max(0.0, (out.max() + 1) / 2))
    return chosen, scores


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    names = model.value.languages
    for batch in batches:
        chosen, scores = _choose(batch["text"], batch["lettered"].to_numpy(zero_copy_only=False), model.value)
        predicted = pa.array([names[c] if c >= 0 else "und" for c in chosen], pa.string())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], predicted, pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])


def _known(batches: Iterator[pa.RecordBatch], model, wanted: frozenset[str] | None, least: float) -> Iterator[pa.RecordBatch]:
    names = model.value.languages
    fine = np.array([wanted is None or n in wanted for n in names], bool)
    for batch in batches:
        lettered = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        chosen, scores = _choose(batch["text"], lettered, model.value)
        stays = lettered & fine[chosen] & (scores >= least) if names else lettered
        yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(stays))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the languages of rows with a lang, whose crc32(doc_id) modulo 4 is not 2.

    About ``sample`` ids of each language are taken, by a hash of the id, so
    that a rare one is learned too; all if there are fewer. The LANGUAGES
    commonest langs are learned, by ids; the more there are, the fewer ids and
    landmarks each has, so that the driver's memory is bounded. Of an id with
    several texts in a language, that of the least hash counts.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(4, 2) & (F.octet_length("text") > 0)).select("doc_id", "text", "lang")
    ids = known.select("doc_id", "lang").distinct()
    common = [r["lang"] for r in ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    chosen = sample_of(ids.where(F.col("lang").isin(common)), min(sample, ALL_SAMPLE // max(1, len(common))), kind="lang")
    # At most about `sample` ids of each language are broadcast.
    rows = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("t"))
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id", "lang").select("t.text", "lang").toArrow()
    texts = [ids for chunk in rows["text"].chunks for _, ids in _presence(*kernels.utf8(chunk))]
    return train(texts, rows["lang"].to_pylist())


def _lettered() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    A null, empty or letterless text is ``und`` with score 0, and so is every
    text if nothing was learned. Ties go to the first language in order.
    Repeated rows each keep a row; a null id stays null and is not held out;
    other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(4, 2).alias("held_out"), _lettered().alias("lettered"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    return arrow_job(rows, partial(_predict, model=shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, wanted: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """The rows in a ``wanted`` language (None: any learned one) with a score of ``least`` or more, with all their columns.

    Each row is judged by its own text; null, empty and letterless texts go.
    Where no language was learned, every text with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_job(docs.select("*", _lettered()), partial(_known, model=shared, wanted=None if wanted is None else frozenset(wanted), least=least), docs.schema)


def op7_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
