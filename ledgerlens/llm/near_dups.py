"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words. A shingle's weight is the number of times
it occurs in the text by an inverse document frequency between 1 and 2.
Consistent weighted samples of two texts agree with the probability of their
weighted Jaccard similarity. Bands of samples make candidates, and candidates
are verified on whole texts by their weighted Jaccard similarity.

Texts are held against each other in blocks: a task gets each text of a block
once and gives back links only, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import kernels
from ledgerlens.llm.common import arrow_job, measured, table, written
from ledgerlens.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Samples per band, and bands. A pair of similarity 0.8 meets in a band with probability 0.998.
ROWS, BANDS = 4, 12
SAMPLES = ROWS * BANDS
#: Pairs that agree in fewer samples are not verified after the first round: at similarity 0.8 that is 4 in 10,000.
LEAST_AGREEMENT = 29
#: Shingles of a smaller share of all documents weigh alike; so at most (mean shingles of a document) / COMMON have another weight.
COMMON = 0.005
#: Buckets of the sketch that tells which shingles can be that common.
SKETCH_BITS = 18
#: Rows of a few longs that are broadcast rather than shuffled.
BROADCAST_ROWS = 100_000
#: Members and shingles of a block, in the mean.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19


def text_key(text: Column) -> list[Column]:
    """128 bits of a text, as columns k1 and k2: equal texts are one."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


KEY = ["k1", "k2"]


# --- numpy side ------------------------------------------------------------------------------------------------------


def _shingles(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles with repeats) of each text of a batch."""
    raw, at = kernels.utf8(batch[column])
    for lo, hi in kernels.chunks(at):
        words, begin = kernels.word_hashes(raw, at[lo : hi + 1])
        for row in range(lo, hi):
            yield row, kernels.shingle_hashes(words[begin[row - lo] : begin[row - lo + 1]], SHINGLE)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, documents, place = np.zeros(1 << SKETCH_BITS, np.int64), 0, np.zeros(1 << SKETCH_BITS, np.int32)
    for batch in batches:
        for _, shingles in _shingles(batch, "text"):
            if len(shingles):
                documents += 1
                counts[kernels.once(_bucket(shingles), place)] += 1
    full = np.flatnonzero(counts)
    for lo in range(0, len(full), 65_536):
        part = full[lo : lo + 65_536]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(part.astype(np.int32)), "n": pa.array(counts[part])})
    yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1], pa.int32()), "n": pa.array([documents], pa.int64())})


def _frequencies(batches: Iterator[pa.RecordBatch], heavy) -> Iterator[pa.RecordBatch]:
    """(shingle, documents) of the shingles in heavy buckets, summed up before they leave the task."""
    wanted, parts, size = heavy.value, [], 0

    def summed() -> pa.RecordBatch:
        shingle, n = np.unique(np.concatenate([*parts, np.empty(0, np.uint64)]), return_counts=True)
        return pa.RecordBatch.from_pydict({"shingle": pa.array(shingle.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    for batch in batches:
        for _, shingles in _shingles(batch, "text"):
            parts.append(np.unique(shingles[wanted[_bucket(shingles)]]))
            size += len(parts[-1])
            if size > 1 << 22:
                yield summed()
                parts, size = [], 0
    yield summed()


def idf_table(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of at least a share COMMON of all documents, sorted, and their weights.

    A weight is 1 + ln(N/df) / ln(1/COMMON), and 2 for all other shingles. So
    it depends on relative frequencies alone, and is the same at every size.
    Frequencies are exact: a sketch over all documents only leaves out buckets
    in which no shingle can be that common.
    """
    rows = arrow_job(texts.select("text"), _sketch, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    documents = int(n[bucket < 0].sum())
    heavy = np.zeros(1 << SKETCH_BITS, bool)
    heavy[bucket[(bucket >= 0) & (n >= COMMON * documents)]] = True
    if not heavy.any():
        return np.empty(0, np.uint64), np.empty(0)
    shared = texts.sparkSession.sparkContext.broadcast(heavy)
    found = arrow_job(texts.select("text"), partial(_frequencies, heavy=shared), "shingle long, n long")
    rows = found.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON * documents).toArrow()
    shared.destroy()
    shingle = rows["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], (1 + np.log(documents / rows["n"].to_numpy()) / np.log(1 / COMMON))[order]


def weighted(shingles: np.ndarray, idf: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles in order, and their weights."""
    common, weight_of = idf
    distinct, times = np.unique(shingles, return_counts=True)
    if not len(common):
        return distinct, times * 2.0
    at = np.minimum(np.searchsorted(common, distinct), len(common) - 1)
    return distinct, times * np.where(common[at] == distinct, weight_of[at], 2.0)


_draws: list[tuple[np.ndarray, ...]] = []


def _tables() -> tuple[np.ndarray, ...]:
    """r, 1/r, ln c and beta: a shingle draws each from 4096 rows by bits of its own."""
    if not _draws:
        rng = np.random.Generator(np.random.Philox(20_240_229))
        r = rng.gamma(2, 1, (4096, SAMPLES)).astype(np.float32)
        _draws.append((r, (1 / r).astype(np.float32), np.log(rng.gamma(2, 1, (4096, SAMPLES))).astype(np.float32), rng.random((4096, SAMPLES)).astype(np.float32)))
    return _draws[0]


def samples(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples of a non-empty weighted set, as 64-bit hashes of (shingle, t)."""
    r, inverse, lnc, beta = _tables()
    best, chosen = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    columns = np.arange(SAMPLES)
    for lo in range(0, len(shingles), 8192):
        s = shingles[lo : lo + 8192]
        i, j, k = ((s >> np.uint64(shift) & np.uint64(4095)).astype(np.int64) for shift in (0, 12, 24))
        b = beta[k]
        t = inverse[i] * np.log(weights[lo : lo + 8192]).astype(np.float32)[:, None]
        t += b
        np.floor(t, out=t)
        value = t - b
        value += 1
        value *= r[i]
        np.subtract(lnc[j], value, out=value)
        at = value.argmin(axis=0)
        least = value[at, columns]
        new = least < best
        picked = kernels.mix(s[at] ^ kernels.mix(t[at, columns].astype(np.int64).astype(np.uint64) + np.uint64(0x51ED2701)))
        best, chosen = np.where(new, least, best), np.where(new, picked, chosen)
    return chosen


def _lists(parts: list[np.ndarray], size: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(parts) + 1, size, dtype=np.int32)), pa.array(np.concatenate(parts), kind))


def _signatures(batches: Iterator[pa.RecordBatch], idf) -> Iterator[pa.RecordBatch]:
    weights_of, seen = idf.value, set()
    band_salt = kernels.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        keys = list(zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), strict=True))
        rows, bands, sigs, sizes = [], [], [], []
        for row, shingles in _shingles(batch, "text"):
            # Copies within a task are left out as far as memory goes; the rest go when signatures meet.
            if not len(shingles) or keys[row] in seen:
                continue
            if len(seen) < 200_000:
                seen.add(keys[row])
            picked = samples(*weighted(shingles, weights_of))
            h = band_salt
            for c in range(ROWS):
                h = kernels.mix(h + picked.reshape(BANDS, ROWS)[:, c])
            rows.append(row)
            bands.append(h.view(np.int64))
            sigs.append(picked.astype(np.uint32).view(np.int32))
            sizes.append(len(shingles))
        if rows:
            kept = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["k1"].take(kept), batch["k2"].take(kept), pa.array(sizes, pa.int64()), _lists(bands, BANDS, pa.int64()), _lists(sigs, SAMPLES, pa.int32())], ["k1", "k2", "shingles", "bands", "sig"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two weighted shingle sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    total = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - common
    every = len(a[0]) + len(b[0]) - len(i)
    return (common / total if total else 0.0), (len(i) / every if every else 0.0)


class Block:
    """The weighted shingle sets of a block, laid end to end, so that one text is held against many at once."""

    def __init__(self, texts: pa.Array, idf: tuple[np.ndarray, np.ndarray]):
        sets = [weighted(s, idf) for _, s in _shingles(pa.RecordBatch.from_arrays([texts], ["text"]), "text")]
        self.size = np.array([len(s) for s, _ in sets], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.total = np.array([w.sum() for _, w in sets])
        self.weight = np.concatenate([w for _, w in sets])
        vocabulary, ids = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True)
        self.ids = ids.astype(np.int32)
        self.dense = np.zeros(len(vocabulary))

    def similarities(self, one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted and plain Jaccard similarity of a text to each of the others, none of them without words."""
        own = slice(self.begin[one], self.begin[one + 1])
        self.dense[self.ids[own]] = self.weight[own]
        sizes = self.size[others]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.repeat(self.begin[others] - first, sizes) + np.arange(sizes.sum())
        common = np.minimum(self.dense[self.ids[at]], self.weight[at])
        meet = np.add.reduceat(common, first)
        both = np.add.reduceat((common > 0).astype(np.int64), first)
        self.dense[self.ids[own]] = 0
        return meet / (self.total[one] + self.total[others] - meet), both / (self.size[one] + sizes - both)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows that have the same keys, in input that is sorted by them."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch[k][row].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            column = batch[k].to_numpy(zero_copy_only=False)
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and lo == 0 and key(held[-1], held[-1].num_rows - 1) != key(batch, 0) or held and lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("similarity", pa.float64()), ("plain", pa.float64())])


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_LINK.types)], schema=_LINK)


def _against_head(batches: Iterator[pa.RecordBatch], idf, least: float) -> Iterator[pa.RecordBatch]:
    """Blocks of members of one head (head, block, node, text): the head itself is among the rows of each."""
    for group in _groups(batches, ["head", "block"]):
        node, head = group["node"].to_numpy(), group["head"][0].as_py()
        _, alone = np.unique(node, return_index=True)
        node = node[alone]
        block = Block(group["text"].combine_chunks().take(pa.array(alone)), idf.value)
        at, others = np.flatnonzero(node == head), np.flatnonzero(node != head)
        if len(at) and len(others):
            near, plain = block.similarities(int(at[0]), others)
            yield _links([(int(node[o]), head, float(s), float(p)) for o, s, p in zip(others, near, plain, strict=True) if s >= least])


class _Joined:
    """Disjoint sets of small whole numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _pending(group: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, others, agreement) of a block's pairs that are not joined yet and may be near.

    A pair counts if its labels differ, if this band is the first in which it
    meets, and if it agrees in LEAST_AGREEMENT samples. In a block of two
    sides only pairs of both sides count.
    """
    band, across = group["band"][0].as_py(), group["i"][0].as_py() != group["j"][0].as_py()
    label, side = group["label"].to_numpy(), group["side"].to_numpy()
    bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    sig = group["sig"].combine_chunks().flatten().to_numpy().reshape(-1, SAMPLES)
    n = len(label)
    for row in np.flatnonzero(side == 0) if across else range(n - 1):
        rest = np.flatnonzero(side == 1) if across else np.arange(row + 1, n)
        rest = rest[label[rest] != label[row]]
        if len(rest):
            rest = rest[~(bands[rest, :band] == bands[row, :band]).any(axis=1)]
        if len(rest):
            agree = (sig[rest] == sig[row]).sum(axis=1)
            near = agree >= LEAST_AGREEMENT
            if near.any():
                yield row, rest[near], agree[near]


_PLACE = ["band", "hash", "i", "j"]


def _unsettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks (band, hash, i, j, ...) that take part in a pending pair, without texts."""
    for group in _groups(batches, _PLACE):
        label = group["label"].to_numpy()
        if (label != label[0]).any():
            part = np.zeros(len(label), bool)
            for row, others, _ in _pending(group):
                part[row] = True
                part[others] = True
            if part.any():
                yield from group.take(pa.array(np.flatnonzero(part))).combine_chunks().to_batches()


def _settle(batches: Iterator[pa.RecordBatch], idf, least: float) -> Iterator[pa.RecordBatch]:
    """Verifies the pending pairs of blocks (band, hash, i, j, ..., text); gives links that join what isn't joined yet."""
    for group in _groups(batches, _PLACE):
        _, alone = np.unique(np.array([group["node"].to_numpy(), group["side"].to_numpy()]), axis=1, return_index=True)
        group = group.take(pa.array(np.sort(alone)))
        node, block = group["node"].to_numpy(), Block(group["text"].combine_chunks(), idf.value)
        _, label = np.unique(group["label"].to_numpy(), return_inverse=True)
        joined, found = _Joined(len(label)), []
        for row, others, agree in _pending(group):
            others = others[np.argsort(-agree, kind="stable")]
            own = joined.find(int(label[row]))
            others = others[[joined.find(int(label[o])) != own for o in others]]
            if len(others):
                for o, s, p in zip(others, *block.similarities(row, others), strict=True):
                    if s >= least and joined.join(int(label[row]), int(label[o])):
                        found.append((int(node[row]), int(node[o]), float(s), float(p)))
        if found:
            yield _links(found)


# --- Spark side ------------------------------------------------------------------------------------------------------


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _with_texts(members: DataFrame, rows: int, texts: DataFrame) -> DataFrame:
    """The members (k1, k2, first_id, ...) with their text, which moves once for each of them."""
    members = members.withColumnsRenamed({"k1": "m1", "k2": "m2", "first_id": "m_id"})
    on = (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")) & F.col("doc_id").eqNullSafe(F.col("m_id"))
    return texts.join(_small(members, rows), on).drop("k1", "k2", "m1", "m2", "doc_id", "m_id")


def _in_order(df: DataFrame, keys: list[str], work: Callable, schema: str | None = None) -> DataFrame:
    return arrow_job(df.repartition(*keys).sortWithinPartitions(*keys), work, schema or "u long, v long, similarity double, plain double")


def nodes_of(docs: DataFrame) -> DataFrame:
    """(k1, k2, first_id, n_rows, node): every text that isn't null once, with a number of its own."""
    keys = docs.where("text is not null").select(*text_key(F.col("text")), "doc_id")
    keys = keys.groupBy(*KEY).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"))
    return written(keys.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _dealt(named: DataFrame) -> DataFrame:
    """(band, hash, i, j, side, node, label): blocks in which members of buckets with several labels meet; named is (band, hash, node, shingles, label).

    Members of a bucket's commonest label need not meet each other. They are
    dealt to blocks, and so are the others, the strays: a block of strays meets
    each block of the label (i below 0), and each block of strays. So a
    bucket of a million copies and one stray is a million rows and one for each block.
    """
    size = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    of_label = named.groupBy("band", "hash", "label").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles"))
    bucket = of_label.groupBy("band", "hash").agg(F.max(F.struct("n", "label", "shingles")).alias("main"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).where("n > main.n")
    bucket = bucket.select("band", "hash", F.col("main.label").alias("main"), F.greatest(F.ceil(F.col("main.n") / BLOCK), F.ceil(F.col("main.shingles") / BLOCK_SHINGLES)).alias("mains"), (F.col("n") - F.col("main.n")).alias("n"), (F.col("shingles") - F.col("main.shingles")).alias("shingles"))
    met = named.drop("shingles").join(bucket.select("band", "hash", "main", "mains", size.alias("strays")), ["band", "hash"])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("label") == F.col("main"), F.col("mains")).otherwise(F.col("strays")))
    met = met.withColumn("own", own)
    place = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("int").alias("side"))
    upto = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)
    main = upto("strays", lambda s: place(-1 - s, F.col("own"), F.lit(1)))
    stray = F.concat(upto("mains", lambda m: place(-1 - F.col("own"), m, F.lit(0))), upto("strays", lambda s: place(F.least("own", s), F.greatest("own", s), F.col("own") > s)))
    return met.select("band", "hash", "node", "label", F.inline(F.when(F.col("label") == F.col("main"), main).otherwise(stray)))


def links(docs: DataFrame, nodes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Verified links (u, v, similarity, plain) between nodes of different texts, enough to join each class of them.

    First every text is held against the least node that it shares a bucket
    with. Then, in each bucket whose members were not all joined so, every
    pair that still lies apart and agrees in LEAST_AGREEMENT samples is
    verified, in blocks of the bucket.
    """
    spark = docs.sparkSession
    texts = docs.where("text is not null").select(*text_key(F.col("text")), "doc_id", "text")
    idf = spark.sparkContext.broadcast(idf_table(texts))
    signed = arrow_job(texts.select(*KEY, "text"), partial(_signatures, idf=idf), "k1 long, k2 long, shingles long, bands array<long>, sig array<int>")
    signed = written(signed.dropDuplicates(KEY).join(nodes, KEY).select("node", *KEY, "first_id", "shingles", "bands", "sig"), "signatures")
    banded = signed.select("node", "shingles", F.posexplode("bands").alias("band", "hash"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).alias("blocks")
    buckets = banded.groupBy("band", "hash").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1").drop("size")
    # From here on only members of shared buckets move.
    grouped = written(banded.join(buckets, ["band", "hash"]), "buckets")
    names = signed.select("node", *KEY, "first_id")

    first = grouped.groupBy("node").agg(F.min("head").alias("head"), F.first("shingles").alias("shingles")).where("node != head")
    sizes = first.groupBy("head").agg(blocks)
    dealt = first.join(sizes, "head").select("node", "head", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    heads = sizes.select(F.col("head").alias("node"), "head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    asked, seen = measured(dealt.union(heads).join(names, "node"), "pairs", n=F.count(F.lit(1)))
    found = written(_in_order(_with_texts(asked, seen["n"], texts), ["head", "block"], partial(_against_head, idf=idf, least=least)), "links")

    # A node's label: what it was joined with, two steps far.
    star = found.select(F.col("u").alias("node"), F.col("v").alias("near"))
    label = star.join(star.select(F.col("node").alias("near"), F.col("near").alias("far")), "near", "left").select("node", F.coalesce("far", "near").alias("label"))
    named = grouped.join(label, "node", "left").select("band", "hash", "node", "shingles", F.coalesce("label", "node").alias("label"))
    members = _dealt(named)
    rows = "band int, hash long, i long, j long, side int, node long, label long, k1 long, k2 long, first_id " + dict(nodes.dtypes)["first_id"] + ", bands array<long>, sig array<int>"
    asked, seen = measured(_in_order(members.join(signed.drop("shingles"), "node").select(*(c.split()[0] for c in rows.split(", "))), _PLACE, _unsettled, rows), "pending", n=F.count(F.lit(1)))
    if seen["n"]:
        found = found.union(written(_in_order(_with_texts(asked, seen["n"], texts), _PLACE, partial(_settle, idf=idf, least=least)), "links"))
    idf.destroy()
    return found


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """(k1, k2, first_id, n_rows, class): every text that isn't null, and the node that names its class."""
    nodes = nodes_of(docs)
    return nodes.join(components(links(docs, nodes, least)), "node", "left").select(*KEY, "first_id", "n_rows", F.coalesce("component", "node").alias("class"))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size) of every row: classes of copies and of linked texts.

    A class is named by its least doc_id. Two texts are linked if their
    weighted Jaccard similarity is at least ``least``. Equal texts, also empty
    ones, are one class; texts without words are linked with nothing else; a
    null text is alone. A shorter text than five words is one shingle.
    Repeated rows are copies. Null ids stay null and never name a class that
    has others. Other columns are left out. An empty table has no classes.
    """
    rows = written(_classes(docs, least), "node-classes")
    named = rows.groupBy("class").agg(F.min("first_id").alias("class_id"), F.sum("n_rows").alias("class_size"))
    of_text = rows.join(named, "class").select(*KEY, "class_id", "class_size")
    known = docs.where("text is not null").select(*text_key(F.col("text")), "doc_id").join(of_text, KEY).select("doc_id", "class_id", "class_size")
    return known.union(docs.where("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs without those that repeat another: the least doc_id of each class stays.

    All columns are kept. Of repeated rows (equal id and text) one stays;
    null texts all stay, and so does a class whose ids are all null, by one of
    its rows. Empty and wordless texts are classes of equal texts.
    """
    rows = written(_classes(docs, least), "node-classes")
    # Null ids sort last, so that an id of the class stays where there is one.
    key = F.struct(F.col("first_id").isNull().alias("a"), F.col("first_id").alias("b"), F.col("k1").alias("c"), F.col("k2").alias("d"))
    best = rows.groupBy("class").agg(F.min(key).alias("best"), F.sum("n_rows").alias("size"), F.count("*").alias("texts"))
    crowded = best.where("size > 1")
    stays = crowded.select(F.col("best.c").alias("k1"), F.col("best.d").alias("k2"), F.col("best.b").alias("_id"))
    # Every text of a class of several rows, with the id that stays of it, if any.
    judged = rows.join(crowded.select("class"), "class").select(*KEY).join(stays.withColumn("_kept", F.lit(True)), KEY, "left")
    judged, seen = measured(judged.withColumnsRenamed({"k1": "_m1", "k2": "_m2"}), "judged", n=F.count(F.lit(1)))
    full = docs.where("text is not null").select(F.struct("*").alias("_doc"), *(c.alias(f"_{k}") for k, c in zip(KEY, text_key(F.col("text")), strict=True)), F.col("doc_id").alias("_doc_id"))
    met = full.join(_small(judged, seen["n"]), (F.col("_k1") == F.col("_m1")) & (F.col("_k2") == F.col("_m2")), "left")
    alone = met.where("_m1 is null").select("_doc.*")
    kept = met.where(F.col("_kept") & F.col("_doc_id").eqNullSafe(F.col("_id"))).dropDuplicates(["_k1", "_k2"]).select("_doc.*")
    return docs.where("text is null").union(alone).union(kept)


def op3_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
