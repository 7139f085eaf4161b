"""Transformers with fit and transform: pruning, encoders of many columns, field-aware rows. Fitted state is small tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType, NumericType

from ledgerlens.functions.stats import bin_of, md5_bucket, woe
from ledgerlens.operators import encode
from ledgerlens.operators.binning import edges_of
from ledgerlens.operators.evaluate import null_woe, value_counts, woe_table
from ledgerlens.operators.mdlp import gini_cuts
from ledgerlens.operators.profile import describe_columns, kinds, long_form, prune_list
from ledgerlens.operators.ranks import numbered, quantiles, value_table
from ledgerlens.session import ship


def by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric columns, and the others."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    return numeric, [c for c in df.columns if c not in numeric]


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def binary_target(df: DataFrame, label: str) -> None:
    """Refuses a label that hasn't exactly two values."""
    n = df.agg(F.count_distinct(label)).first()[0]
    if n != 2:
        raise ValueError(f"{label} has {n} values, not two")


class Preprocess:
    """Drops columns that are too often null or too often the same, and repeated rows.

    Thresholds up to 1 are shares of rows, others numbers of rows: a column
    goes if it has fewer known values than ``notnull``, or if its commonest
    value leaves fewer other rows than ``notsame``.
    """

    def __init__(self, notnull: float = 100, notsame: float = 20, drop_duplicates: bool = False):
        self.notnull, self.notsame, self.drop_duplicates = notnull, notsame, drop_duplicates
        self.gone: list[str] = []
        self.report: DataFrame | None = None

    def fit(self, df: DataFrame) -> Preprocess:
        self.report = describe_columns(df, df.columns)
        n = F.col("null_num") + F.col("notnull_num")
        share = lambda t: F.lit(float(t)) if t <= 1 else F.lit(float(t)) / n
        gone = self.report.where((F.col("notnull_num") / n < share(self.notnull)) | (F.col("most_value_num") / n > 1 - share(self.notsame)))
        # One row a column.
        self.gone = sorted(r[0] for r in gone.select("feature").collect())
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.drop(*self.gone)
        return out.dropDuplicates() if self.drop_duplicates else out


def drop_redundant(df: DataFrame, nan: float = 100, same: float = 100, drop_duplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """The frame without columns whose share of nulls, or of the commonest value, is above 1 - threshold; and their figures, most nulls first."""
    made = Preprocess(nan, same, drop_duplicates).fit(df)
    return made.transform(df), made.report.orderBy(F.desc("null_num"), "feature")


class Encoder:
    """One column at a time becomes a number. ``fit`` makes a table (value, code) and a code for values that it lacks."""

    def fit(self, df: DataFrame, columns: list[str], label: str | None = None) -> Encoder:
        self.columns, self.tables = columns, {c: self.table(df, c, label) for c in columns}
        return self

    def table(self, df: DataFrame, column: str, label: str | None) -> tuple[DataFrame, float | None]:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.columns:
            codes, unseen = self.tables[c]
            small = codes.select(F.col("value").alias("_v"), F.col("code").cast("double").alias("_c"))
            # Not broadcast by hint: a column may have many values, and Spark knows the table's size.
            out = out.join(small, F.col(c).cast("string").eqNullSafe(F.col("_v")), "left").withColumn(c, F.coalesce("_c", F.lit(unseen).cast("double"))).drop("_v", "_c")
        return out


class LabelEncoder(Encoder):
    """Rank among the distinct values and the sentinel for unseen ones."""

    def table(self, df, column, label):
        codes = encode.label_codes(df.select(F.col(column).cast("string").alias(column)), column)
        return codes, codes.where(F.col("value") == encode.UNKNOWN).first()["code"]


class CountEncoder(Encoder):
    """(Logarithm of) the count plus smoothing; unseen values count 1."""

    def __init__(self, smoothing: int = 1, log: bool = True):
        self.smoothing, self.log = smoothing, log

    def table(self, df, column, label):
        n = F.count("*") + self.smoothing
        return df.groupBy(F.col(column).cast("string").alias("value")).agg((F.ln(n) if self.log else n).alias("code")), 0.0 if self.log else 1.0


#: Numbers that are drawn at once.
DRAWN = 1 << 20


def _with_noise(batches: Iterator[pa.RecordBatch], scale: float, seed: int) -> Iterator[pa.RecordBatch]:
    """(value, code) of rows in order of ``place``: the place'th normal number of the seed's sequence is added.

    The sequence can't be entered in its middle, so a task draws all numbers
    before its own, DRAWN at a time: 20 s for a billion.
    """
    draw, begin, block = np.random.RandomState(seed), 0, np.empty(0)
    for batch in batches:
        place, noise = batch["place"].to_numpy(), np.empty(batch.num_rows)
        at = 0
        while at < len(place):
            while place[at] >= begin + len(block):
                begin, block = begin + len(block), draw.normal(0, scale, DRAWN)
            end = int(np.searchsorted(place, begin + len(block)))
            noise[at:end] = block[place[at:end] - begin]
            at = end
        yield pa.RecordBatch.from_arrays([batch["value"], pa.array(batch["encoded"].to_numpy() + noise)], ["value", "code"])


class TargetEncoder(Encoder):
    """Mean label drawn to the overall mean by a share of the value's rows, with seeded noise for each value in order; unseen: the mean."""

    def __init__(self, noise: float = 0.05, smoothing: float = 0.1, seed: int = 10):
        self.noise, self.smoothing, self.seed = noise, smoothing, seed

    def table(self, df, column, label):
        means = encode.target_means(df.select(F.col(column).cast("string").alias(column), label), column, label, self.smoothing, digits=12)
        overall = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
        if not self.noise:
            return means.select("value", F.col("encoded").alias("code")), overall
        ship(df.sparkSession)
        ranked = numbered(means, ["value"], "place").select("value", "encoded", "place").repartitionByRange("place").sortWithinPartitions("place")
        return ranked.mapInArrow(partial(_with_noise, scale=self.noise, seed=self.seed), "value string, code double"), overall


class WoeEncoder(Encoder):
    """Weight of evidence of a number's quantile bin; nulls get their own, from counts that a share of rows is added to."""

    def __init__(self, bins: int = 10, null_share: float = 0.01):
        self.bins, self.null_share = bins, null_share

    def fit(self, df, columns, label=None):
        binary_target(df.where(F.col(label).isNotNull()), label)
        self.columns = columns
        counts = value_counts(df, columns, label)
        from ledgerlens.operators.evaluate import binned

        edges = edges_of(long_form(df, columns, "double").where("value is not null"), ["feature"], bins=self.bins)
        table = woe_table(binned(counts, ["feature"], self.bins), ["feature"], "bin")
        self.edges = {r["feature"]: list(r["edges"]) for r in edges.collect()}
        self.codes: dict[str, dict[int, float]] = {}
        for r in table.collect():  # one row for each bin
            self.codes.setdefault(r["feature"], {})[r["bin"]] = r["woe"]
        self.null = {c: null_woe(df, c, label, self.null_share).first()["woe"] for c in columns}
        return self

    def transform(self, df):
        def code(c: str) -> Column:
            at = bin_of(F.col(c).cast("double"), F.array(*(F.lit(e) for e in self.edges[c])).cast("array<double>"))
            found = F.create_map(*(F.lit(x) for kv in self.codes[c].items() for x in kv))
            return F.when(F.col(c).isNull(), F.lit(self.null[c])).otherwise(F.try_element_at(found, at.cast("int")))

        return df.withColumns({c: code(c) for c in self.columns})


class CategoryWoeEncoder(Encoder):
    """Weight of evidence of a category; unseen values get 0."""

    def table(self, df, column, label):
        binary_target(df.where(F.col(label).isNotNull()), label)
        y = F.col(label) > 0
        g = df.where(F.col(label).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("q"))
        total = df.where(F.col(label).isNotNull()).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("q")).first()
        return g.select("value", woe(F.col("p"), F.col("q"), F.lit(total["p"]), F.lit(total["q"])).alias("code")), 0.0


class BinningEncoder(Encoder):
    """Number of a value's bin, or one of ``labels``; bins by trees on the label (``dt``), quantiles or width."""

    def __init__(self, bins: int = 10, method: str = "dt", labels: list[float] | None = None, max_depth: int = 4):
        if labels is not None and len(labels) != bins:
            raise ValueError("as many labels as bins are asked for")
        self.bins, self.method, self.labels, self.max_depth = bins, method, labels, max_depth

    def fit(self, df, columns, label=None):
        self.columns = columns
        if self.method == "dt" and label:
            cuts = gini_cuts(value_counts(df, columns, label), ["feature"], self.max_depth)
            self.edges = {k[0]: v for k, v in cuts.items()}
        else:
            rows = edges_of(long_form(df, columns, "double").where("value is not null"), ["feature"], "qcut" if self.method == "dt" else self.method, self.bins)
            self.edges = {r["feature"]: list(r["edges"]) for r in rows.collect()}
        return self

    def transform(self, df):
        at = lambda c: bin_of(F.col(c).cast("double"), F.array(*(F.lit(e) for e in self.edges.get(c, []))).cast("array<double>"))
        pick = (lambda x: x) if self.labels is None else (lambda x: F.get(F.array(*(F.lit(v) for v in self.labels)), x.cast("int")))
        return df.withColumns({c: pick(at(c)) for c in self.columns})


class OneHotEncoder(Encoder):
    """0/1 columns of the values seen, at most ``most`` of them; others are all 0."""

    def __init__(self, most: int = 1000):
        self.most = most

    def fit(self, df, columns, label=None):
        self.columns, self.values = columns, {}
        for c in columns:
            found = [r[0] for r in df.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().orderBy(c).limit(self.most + 1).collect()]
            if len(found) > self.most:
                raise ValueError(f"{c} has more than {self.most} values")
            self.values[c] = found
        return self

    def transform(self, df):
        out = df
        for c in self.columns:
            out = encode.one_hot(out, c, self.values[c]).drop(c)
        return out


class NothingEncoder(Encoder):
    """Leaves columns as they are."""

    def fit(self, df, columns, label=None):
        self.columns = columns
        return self

    def transform(self, df):
        return df


CATEGORY: dict[str, Callable[..., Encoder]] = {"label": LabelEncoder, "count": CountEncoder, "target": TargetEncoder, "onehot": OneHotEncoder, "woe": CategoryWoeEncoder, "none": NothingEncoder}
CONTINUOUS: dict[str, Callable[..., Encoder]] = {"woe": WoeEncoder, "binning": BinningEncoder, "none": NothingEncoder}


def encoder(kind: str, name: str, **settings) -> Encoder:
    """An encoder by the kind of column (category or continuous) and its name."""
    known = {"category": CATEGORY, "continuous": CONTINUOUS}[kind]
    if name not in known:
        raise ValueError(f"unknown {kind} encoder {name!r}; known are {sorted(known)}")
    return known[name](**settings)


class FeatureTransformer:
    """Prunes columns, takes numbers of few values as categories, and encodes categories and numbers each their way."""

    def __init__(self, few: int = 20, cate_cut: float = 0.95, nan_cut: float = 0.95, same_cut: float = 0.95, category: str = "count", continuous: str = "woe"):
        self.few, self.cuts, self.category, self.continuous = few, (nan_cut, same_cut, cate_cut), category, continuous

    def fit(self, df: DataFrame, features: list[str], label: str) -> FeatureTransformer:
        numeric = {f.name for f in df.schema if isinstance(f.dataType, (IntegralType, FractionalType))}
        self.gone = {r["feature"] for r in prune_list(df, features, *self.cuts, numeric=numeric).collect()}
        kept = [c for c in features if c not in self.gone]
        counts = {r["feature"]: r["n_distinct"] for r in kinds(df, kept).collect()} if kept else {}
        self.categories = [c for c in kept if c not in numeric or counts[c] < self.few]
        self.numbers = [c for c in kept if c not in self.categories]
        as_text = cast_columns(df, {c: "string" for c in self.categories})
        self.parts = [encoder("category", self.category).fit(as_text, self.categories, label), encoder("continuous", self.continuous).fit(df, self.numbers, label)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = cast_columns(df.drop(*self.gone), {c: "string" for c in self.categories})
        return reduce(lambda x, part: part.transform(x) if part.columns else x, self.parts, out)


class FieldAwareEncoder:
    """Rows of `field:index:value` tokens: numbers first, scaled between their 5 % and 95 % quantiles, then categories by frequency.

    Values of fewer than ``cutoff`` rows, unseen ones and nulls share a field's first index.
    """

    def __init__(self, cutoff: int = 1):
        self.cutoff = cutoff

    def fit(self, df: DataFrame, numbers: list[str], categories: list[str]) -> FieldAwareEncoder:
        self.numbers, self.categories = numbers, categories
        long = df.select(*(F.col(c).cast("double").alias(c) for c in numbers)).unpivot([], numbers, "feature", "value") if numbers else None
        found = {r["feature"]: r["q"] for r in quantiles(value_table(long, ["feature"]), ["feature"], [0.05, 0.95]).collect()} if numbers else {}
        self.ends = {c: found.get(c, [0.0, 0.0]) for c in numbers}
        self.tables, offset = {}, len(numbers)
        for c in categories:
            table = encode.ffm_vocabulary(df.select(F.col(c).cast("string").alias(c)), c, self.cutoff, offset)
            self.tables[c] = (table.where(F.col("value") != "<unk>"), offset)
            offset += table.count()
        return self

    def transform(self, df: DataFrame, label: str | None = None, out: str = "line") -> DataFrame:
        """The frame with one text column of tokens, the label first if given."""
        full, tokens = df, [F.col(label).cast("string")] if label else []
        for i, c in enumerate(self.numbers):
            low, high = self.ends[c]
            x = F.col(c).cast("double")
            scaled = F.coalesce((F.least(F.greatest(x, F.lit(low)), F.lit(high)) - low) / (high - low), F.lit(0.0)) if high > low else F.lit(0.0)
            tokens.append(F.format_string(f"{i}:{i}:%.6f", scaled))
        for k, c in enumerate(self.categories, len(self.numbers)):
            table, first = self.tables[c]
            small = table.select(F.col("value").alias(f"_v{k}"), F.col("idx").alias(f"_i{k}"))
            full = full.join(small, F.col(c).cast("string") == F.col(f"_v{k}"), "left")
            tokens.append(F.concat_ws(":", F.lit(k), F.coalesce(f"_i{k}", F.lit(first)), F.lit(1)))
        return full.select(*df.columns, F.concat_ws(" ", *tokens).alias(out))


def hashed_tokens(df: DataFrame, numbers: list[str], categories: list[str], buckets: int = 1_000_000) -> Column:
    """One text of hashed `field:bucket:1` tokens: a category by field and value, a number by its value."""
    parts = [F.when(F.col(c).isNotNull(), F.concat_ws(":", F.lit(i), md5_bucket(F.col(c).cast("string"), buckets), F.lit(1))) for i, c in enumerate(numbers)]
    parts += [F.when(F.col(c).isNotNull(), F.concat_ws(":", F.lit(i), md5_bucket(F.concat(F.lit(f"{c}-"), F.col(c).cast("string")), buckets), F.lit(1))) for i, c in enumerate(categories, len(numbers))]
    return F.concat_ws(" ", *parts)

