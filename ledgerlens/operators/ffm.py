"""Field-aware factorisation machine on libFFM rows: gradients of partitions, added up by index, one job an epoch.

A feature has one latent vector for each field that it meets. The driver holds
the model, one row for each index bucket in use; rows never leave their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.weights import weighed
from ledgerlens.session import ship, written

#: Row of the gradients that holds losses and counts instead, and the bias's.
LOSSES, BIAS = -2, -1


def parsed(df: DataFrame, line: str = "line", buckets: int = 1 << 16) -> DataFrame:
    """The rows with label, fields, indices and values of `label field:index:value ...` texts; indices fold into ``buckets``.

    A text without a label has a null one; tokens that aren't three numbers are left out.
    """
    tokens = F.filter(F.split(F.trim(line), " +"), lambda t: t.rlike(r"^\d+:\d+:[^:]+$"))
    part = lambda i: F.transform(tokens, lambda t: F.split(t, ":")[i])
    first = F.split(F.trim(line), " +")[0]
    return df.select("*", F.when(~first.contains(":"), first).try_cast("double").alias("label"), part(0).cast("array<int>").alias("fields"), F.transform(part(1).cast("array<long>"), lambda i: F.pmod(i, F.lit(buckets))).cast("array<int>").alias("indices"), part(2).cast("array<double>").alias("values"))


def padded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fields, indices and values of a batch as matrices; what a row lacks has value 0."""
    size = np.diff(batch["indices"].offsets.to_numpy())
    shape = (batch.num_rows, int(size.max()) if len(size) else 0)
    at = np.arange(shape[1]) < size[:, None]
    out = []
    for name, kind in (("fields", np.int64), ("indices", np.int64), ("values", np.float64)):
        filled = np.zeros(shape, kind)
        filled[at] = batch[name].flatten().to_numpy(zero_copy_only=False)
        out.append(filled)
    return tuple(out)


@dataclass
class Machine:
    """Weights of a field-aware factorisation machine; ``linear`` and ``latent`` by index bucket."""

    bias: float
    linear: np.ndarray
    latent: np.ndarray

    @classmethod
    def made(cls, buckets: int, fields: int, factors: int, seed: int) -> Machine:
        draw = np.random.default_rng(seed)
        return cls(0.0, np.zeros(buckets), draw.uniform(-0.5, 0.5, (buckets, fields, factors)) / np.sqrt(factors))

    def margins(self, fields: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = self.bias + (self.linear[indices] * values).sum(axis=1)
        for a in range(fields.shape[1]):
            for b in range(a + 1, fields.shape[1]):
                pair = (self.latent[indices[:, a], fields[:, b]] * self.latent[indices[:, b], fields[:, a]]).sum(axis=1)
                out += pair * values[:, a] * values[:, b]
        return out

    def gradient(self, fields: np.ndarray, indices: np.ndarray, values: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(indices in use, gradients of their linear weights, of their latent ones) for ``slope``, the loss's derivative by each margin."""
        used, slot = np.unique(indices, return_inverse=True)
        slot = slot.reshape(indices.shape)
        linear, latent = np.zeros(len(used)), np.zeros((len(used), *self.latent.shape[1:]))
        np.add.at(linear, slot, slope[:, None] * values)
        for a in range(fields.shape[1]):
            for b in range(a + 1, fields.shape[1]):
                scale = (slope * values[:, a] * values[:, b])[:, None]
                np.add.at(latent, (slot[:, a], fields[:, b]), scale * self.latent[indices[:, b], fields[:, a]])
                np.add.at(latent, (slot[:, b], fields[:, a]), scale * self.latent[indices[:, a], fields[:, b]])
        return used, linear, latent


def _log_loss(y: np.ndarray, margin: np.ndarray, n: np.ndarray | float = 1.0) -> float:
    return float((n * np.logaddexp(0, np.where(y > 0, -margin, margin))).sum())


def _epoch(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(index, g): a partition's gradients, and its losses: training loss and rows, validation loss and rows."""
    machine, total, bias = model.value, np.zeros(4), 0.0
    width = machine.latent[0].size
    linear, latent, touched = np.zeros(len(machine.linear)), np.zeros((len(machine.linear), width)), np.zeros(len(machine.linear), bool)
    for batch in batches:
        fields, indices, values = padded(batch)
        y, held, n = batch["label"].to_numpy(zero_copy_only=False) > 0, batch["held"].to_numpy(zero_copy_only=False), batch["n"].to_numpy()
        margin = machine.margins(fields, indices, values)
        total += [_log_loss(y[~held], margin[~held], n[~held]), n[~held].sum(), _log_loss(y[held], margin[held], n[held]), n[held].sum()]
        slope = (n * (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y))[~held]
        bias += slope.sum()
        used, g, h = machine.gradient(fields[~held], indices[~held], values[~held], slope)
        linear[used] += g
        latent[used] += h.reshape(len(used), width)
        touched[used] = True
    rows = np.flatnonzero(touched)
    extra = np.zeros((2, width + 1))
    extra[0, : min(4, width + 1)], extra[1, 0] = total[: width + 1], bias
    g = np.concatenate([extra, np.column_stack([linear[rows], latent[rows]])])
    index = np.concatenate([[LOSSES, BIAS], rows])
    yield pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), *(pa.array(g[:, j]) for j in range(width + 1))], ["index", *(f"g{j}" for j in range(width + 1))])


def ffm_fit(df: DataFrame, validation: DataFrame, line: str = "line", factors: int = 4, buckets: int = 1 << 16, epochs: int = 60, step: float = 0.1, decay: float = 1e-5, patience: int = 5, seed: int = 7, count: str | None = None) -> tuple[Machine, list[tuple[float, float]]]:
    """(machine of the best validation epoch, (training, validation) loss by epoch). Rows without a label are left out.

    An epoch is one job: each partition works out its gradients, Spark adds
    them up by index, first where they are made, and the driver takes one row
    for each index in use for a step of Adam. Training ends ``patience`` epochs
    after the best one. There must be training and validation rows. Equal texts
    are one row with a count where that halves them; ``count`` names a column
    of counts, if they are added up already.
    """
    spark = df.sparkSession
    ship(spark)
    texts = [x.select(line, F.lit(held).alias("held"), *([F.col(count).alias("_n")] if count else [])) for x, held in ((df, False), (validation, True))]
    texts = texts[0].union(texts[1])
    rows = parsed(texts if count else weighed(texts, [line, "held"]), line, buckets).select("label", "fields", "indices", "values", "held", F.col("_n").cast("double").alias("n"))
    rows = written(rows.where("label is not null"), "ffm-rows")
    fields = 1 + (rows.agg(F.max(F.array_max("fields"))).first()[0] or 0)
    width = max(3, fields * factors)
    factors = -(-width // fields)
    now = Machine.made(buckets, fields, factors, seed)
    width = fields * factors
    schema = "index int, " + ", ".join(f"g{j} double" for j in range(width + 1))
    moments, best, curve = [np.zeros((2, buckets, width + 1)), np.zeros(2)], (np.inf, now), []
    for epoch in range(1, epochs + 2):
        shared = spark.sparkContext.broadcast(now)
        found = rows.mapInArrow(partial(_epoch, model=shared), schema).groupBy("index").agg(*(F.sum(f"g{j}").alias(f"g{j}") for j in range(width + 1))).toArrow()
        shared.destroy()
        index, g = found["index"].to_numpy(), np.column_stack([found[f"g{j}"].to_numpy() for j in range(width + 1)])
        train_loss, n, valid_loss, m = g[index == LOSSES][0][:4]
        if not n or not m:
            raise ValueError("training and validation rows are needed")
        curve.append((train_loss / n, valid_loss / m))
        if valid_loss / m < best[0] - 1e-6:
            best, waited = (valid_loss / m, now), 0
        else:
            waited += 1
        if waited >= patience or epoch > epochs:
            break
        used, at = index[index >= 0], g[index >= 0] / n
        weights = np.column_stack([now.linear[used], now.latent[used].reshape(len(used), width)])
        at = at + decay * weights
        first, second = moments[0]
        first[used], second[used] = 0.9 * first[used] + 0.1 * at, 0.999 * second[used] + 0.001 * at**2
        slope = g[index == BIAS][0][0] / n
        moments[1][:] = 0.9 * moments[1][0] + 0.1 * slope, 0.999 * moments[1][1] + 0.001 * slope**2
        rate = step * np.sqrt(1 - 0.999**epoch) / (1 - 0.9**epoch)
        weights = weights - rate * first[used] / (np.sqrt(second[used]) + 1e-8)
        linear, latent = now.linear.copy(), now.latent.copy()
        linear[used], latent[used] = weights[:, 0], weights[:, 1:].reshape(len(used), fields, factors)
        now = Machine(now.bias - rate * moments[1][0] / (np.sqrt(moments[1][1]) + 1e-8), linear, latent)
    return best[1], curve


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields, indices, values = padded(batch)
        known = fields < model.value.latent.shape[1]
        margin = model.value.margins(np.where(known, fields, 0), indices, np.where(known, values, 0.0))
        kept = [c for c in batch.schema.names if c not in ("fields", "indices", "values")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], [*kept, "score"])


def ffm_scores(machine: Machine, df: DataFrame, line: str = "line") -> DataFrame:
    """The rows with their score; fields that training didn't see don't count."""
    spark = df.sparkSession
    ship(spark)
    rows = parsed(df, line, len(machine.linear)).drop("label")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", score double"
    return rows.mapInArrow(partial(_score, model=spark.sparkContext.broadcast(machine)), schema)
