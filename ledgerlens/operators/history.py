"""Loan-history and time-span features: windows per key, then one wide aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ranks import quantiles, value_table

#: The finish of a loan that isn't finished (fixed value).
OPEN = "1000-01-01"
#: Statistics of a span, in order.
STATISTICS = ["min", "max", "mean", "median", "std", "sum", "len", "latest", "share_positive", "positive"]


def valid_history(df: DataFrame, applied: str, finish: str, now: str | None = None, total: str | None = None) -> DataFrame:
    """Loans that were finished before the application, by their last instalment where instalments are given."""
    last = F.col(now) == F.col(total) if now else F.lit(True)
    return df.where((F.col(finish) < F.col(applied)) & (F.col(finish) != F.lit(OPEN).cast("date")) & last)


def ranked_history(df: DataFrame, key: str, created: str, finish: str, expect: str, ident: str | None = None) -> DataFrame:
    """Overdue calendar days, place by finish from the latest, and days from finish to the next start of the key.

    ``nth`` is the average rank, ``place`` the row number, equal finishes in
    order of ``ident``. The latest loan has no next one; its days are counted
    to the key's last date.
    """
    w = Window.partitionBy(key)
    rank = F.rank().over(w.orderBy(F.desc(finish))) + (F.count("*").over(Window.partitionBy(key, finish)) - 1) / 2
    place = F.row_number().over(w.orderBy(F.desc(finish), *([ident] if ident else [F.desc(created)]))).cast("long")
    following = F.lag(created).over(w.orderBy(F.desc(created), *([ident] if ident else [])))
    return df.select("*", F.datediff(finish, expect).cast("long").alias("overdue_days"), rank.alias("nth"), place.alias("place"), F.datediff(F.coalesce(following, F.max(created).over(w)), finish).cast("long").alias("gap_days"))


def _statistics(x: Column, first: Column) -> dict[str, Column]:
    r = lambda e: F.round(e, 6)
    return {"min": F.min(x), "max": F.max(x), "mean": r(F.avg(x)), "median": r(F.median(x)), "std": r(F.stddev_pop(x)), "sum": F.sum(x), "len": F.count(x), "latest": first, "share_positive": r(F.avg((x > 0).cast("int"))), "positive": F.count_if(x > 0)}


def span_statistics(df: DataFrame, key: str, place: str, columns: list[str], spans: list[int | None], statistics: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Statistics of the first ``span`` rows of each key (None: all), as one aggregate; ``statistics`` are further ones by name.

    A row of place 0 is a smoothing value: it counts in every span, and is the
    latest only where there is no other.
    """
    out = []
    for c in columns:
        for span in spans:
            x = F.col(c) if span is None else F.when(F.col(place) <= span, F.col(c))
            latest = F.coalesce(F.max(F.when(F.col(place) == 1, F.col(c))), F.max(F.when(F.col(place) == 0, F.col(c))))
            out += [e.alias(f"{c}_{span or 'all'}_{name}") for name, e in (_statistics(x, latest) | {n: s(x) for n, s in (statistics or {}).items()}).items()]
    return df.groupBy(key).agg(*out)


def clock_counts(df: DataFrame, key: str, ts: str, prefix: str = "") -> DataFrame:
    """24 counts of hours and 7 of weekdays (Monday first) per key."""
    hours = [F.count_if(F.hour(ts) == h).alias(f"{prefix}hour_{h}") for h in range(24)]
    days = [F.count_if(F.weekday(ts) == d).alias(f"{prefix}weekday_{d}") for d in range(7)]
    return df.groupBy(key).agg(*hours, *days)


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "value")
    return {r["feature"]: r["q"][0] for r in quantiles(value_table(long, ["feature"]), ["feature"], [0.5]).collect()}


@dataclass
class HistoryFeatures:
    """Statistics of a key's ranked history by spans, with clock counts of its starts and finishes.

    With ``smooth``, fitting learns the medians of both columns, and each key
    (also those in ``keys`` without history) gets one more value, the median.
    """

    key: str
    spans: list[int | None] = field(default_factory=lambda: [3, None])
    smooth: bool = True
    created: str = "created"
    finish: str = "finish"
    columns: tuple[str, ...] = ("overdue_days", "gap_days")
    learned: dict[str, float] = field(default_factory=dict)
    statistics: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def fit(self, ranked: DataFrame) -> HistoryFeatures:
        self.learned = medians(ranked, list(self.columns)) if self.smooth else {}
        return self

    def transform(self, ranked: DataFrame, keys: DataFrame | None = None, clocks: bool = True) -> DataFrame:
        rows = ranked.select(self.key, "place", *(F.col(c).cast("double").alias(c) for c in self.columns))
        if self.smooth:
            every = (keys if keys is not None else ranked).select(self.key).distinct()
            rows = rows.unionByName(every.select(self.key, F.lit(0).cast("long").alias("place"), *(F.lit(self.learned.get(c)).cast("double").alias(c) for c in self.columns)))
        out = span_statistics(rows, self.key, "place", list(self.columns), self.spans, self.statistics)
        if clocks:
            for name in (self.created, self.finish):
                out = out.join(clock_counts(ranked, self.key, name, f"{name}_"), self.key, "left")
        return out


def _differences(df: DataFrame, keys: list[str], column: str, tie: str | None, unit: int) -> Column:
    w = Window.partitionBy(*keys).orderBy(column, *([tie] if tie else []))
    kind = dict(df.dtypes)[column]
    if kind.startswith(("timestamp", "date")):
        seconds = F.timestamp_diff("SECOND", F.lag(column).over(w), F.col(column)).cast("long")
        return seconds if unit == 1 else seconds / unit
    return F.col(column) - F.lag(column).over(w)


def time_spans(df: DataFrame, key: str, ts: str, hue: str | None = None, tie: str | None = None, unit: int = 1, statistics: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Statistics of the time between a key's successive rows in units of so many seconds, or of a number's steps; per hue if given. ``statistics`` are further ones by name."""
    keys = [key] + ([hue] if hue else [])
    d = df.select(*keys, _differences(df, keys, ts, tie, unit).alias("d"))
    return d.groupBy(*keys).agg(F.min("d").alias("least"), F.max("d").alias("most"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.median("d"), 6).alias("middle"), F.round(F.stddev_pop("d"), 6).alias("std"), F.sum("d").alias("total"), F.count("*").alias("len"), *(s(F.col("d")).alias(n) for n, s in (statistics or {}).items()))


SPANS = ["least", "most", "mean", "middle", "std", "total", "len"]


@dataclass
class TimeSpanFeatures:
    """One row a key: span statistics over all its rows (``margins``) and for each hue that fitting saw.

    Missing figures take ``fill``, or the column's mean over all keys where it
    is None. Neither margins nor a hue is refused.
    """

    key: str
    ts: str
    hue: str | None = None
    margins: bool = True
    tie: str | None = None
    unit: int = 1
    fill: float | None = None
    most: int = 100
    values: list = field(default_factory=list)
    statistics: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> TimeSpanFeatures:
        if not self.margins and not self.hue:
            raise ValueError("margins or a hue is needed")
        if self.hue:
            # Bounded: every value becomes seven columns.
            self.values = [r[0] for r in df.where(F.col(self.hue).isNotNull()).select(self.hue).distinct().orderBy(self.hue).limit(self.most + 1).collect()]
            if len(self.values) > self.most:
                raise ValueError(f"{self.hue} has more than {self.most} values")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        parts, figures = [], [*SPANS, *self.statistics]
        if self.margins:
            whole = time_spans(df, self.key, self.ts, None, self.tie, self.unit, self.statistics)
            parts.append(whole.select(self.key, *(F.col(s).cast("double").alias(f"all_{s}") for s in figures)))
        if self.hue:
            each = time_spans(df, self.key, self.ts, self.hue, self.tie, self.unit, self.statistics)
            parts.append(each.groupBy(self.key).agg(*(F.max(F.when(F.col(self.hue) == v, F.col(s))).cast("double").alias(f"{v}_{s}") for v in self.values for s in figures)))
        out = parts[0] if len(parts) == 1 else parts[0].join(parts[1], self.key, "full")
        names = [c for c in out.columns if c != self.key]
        if self.fill is not None:
            return out.fillna(self.fill, names)
        means = F.broadcast(out.agg(*(F.avg(c).alias(f"_m_{c}") for c in names)))
        return out.join(means).select(self.key, *(F.coalesce(c, f"_m_{c}").alias(c) for c in names))


def earlier_of_same_key(df: DataFrame, key: str, ident: str, ts: str) -> DataFrame:
    """Each row with all earlier rows of its key: (ident, earlier ident)."""
    a = df.select(F.col(key), F.col(ident).alias("current"), F.col(ts).alias("t"))
    b = df.select(F.col(key), F.col(ident).alias("earlier"), F.col(ts).alias("t0"))
    return a.join(b, key).where("t0 < t").select(key, "current", "earlier")
