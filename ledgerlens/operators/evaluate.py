"""WOE, IV, KS and AUC of features, in long form: one shuffle on (keys, value) feeds all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import chi2_p
from ledgerlens.functions.stats import bin_of_few, iv_part, woe
from ledgerlens.operators.binning import inner_quantiles
from ledgerlens.operators.profile import long_form
from ledgerlens.operators.ranks import group_sizes, running, small
from ledgerlens.session import written


def value_counts(df: DataFrame, features: list[str], label: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, value, pos, neg) of non-null values and labels; written once, as what reads it does so several times."""
    rows = long_form(df, features, "double", [*(keys or []), label]).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    y = F.col(label) > 0
    return written(rows.groupBy(*(keys or []), "feature", "value").agg(F.count(F.when(y, 1)).alias("pos"), F.count(F.when(~y, 1)).alias("neg")), "counts")


def woe_table(counts: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(keys, by, pos, neg, woe, iv): weight of evidence and share of IV of each group."""
    groups = counts.groupBy(*keys, by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    w = Window.partitionBy(*keys)
    groups = groups.withColumn("pos_all", F.sum("pos").over(w)).withColumn("neg_all", F.sum("neg").over(w))
    c = [F.col(x) for x in ("pos", "neg", "pos_all", "neg_all")]
    return groups.select(*keys, by, "pos", "neg", F.round(woe(*c), 6).alias("woe"), F.round(iv_part(*c), 6).alias("iv"))


def binned(counts: DataFrame, keys: list[str], bins: int = 10, sizes: tuple[int, int] | None = None) -> DataFrame:
    """The counts with a quantile bin, edges weighted by the counts."""
    most, groups = sizes or group_sizes(counts, keys)
    edges = inner_quantiles(counts, keys, bins, n=F.col("pos") + F.col("neg"), most=most)
    return counts.join(small(edges, groups), keys).withColumn("bin", bin_of_few("value", "edges", bins - 1)).drop("edges")


def information_value(counts: DataFrame, keys: list[str], bins: int = 10, sizes: tuple[int, int] | None = None) -> DataFrame:
    groups = binned(counts, keys, bins, sizes).groupBy(*keys, "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    w = Window.partitionBy(*keys)
    groups = groups.withColumn("pos_all", F.sum("pos").over(w)).withColumn("neg_all", F.sum("neg").over(w))
    return groups.groupBy(*keys).agg(F.round(F.sum(iv_part(*(F.col(x) for x in ("pos", "neg", "pos_all", "neg_all")))), 6).alias("iv"))


def ks_auc(counts: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """(keys, ks, auc): greatest distance of the class distributions; tie-aware area, turned to 0.5 or more."""
    run = running(counts.select(*keys, "value", "pos", "neg"), keys, ["value"], ["pos", "neg"], most=most)
    run = run.withColumnsRenamed({"cum_pos": "cp", "cum_neg": "cn", "all_pos": "p", "all_neg": "n"})
    ks = F.max(F.abs(F.try_divide("cp", "p") - F.try_divide("cn", "n")))
    # Pairs in which the event has the greater value, ties one half.
    area = F.try_divide(F.sum(F.col("pos").cast("double") * (F.col("cn") - F.col("neg") / 2)), F.max(F.col("p").cast("double") * F.col("n")))
    out = run.groupBy(*keys).agg(ks.alias("ks"), area.alias("area"))
    return out.select(*keys, F.round("ks", 6).alias("ks"), F.round(F.greatest("area", 1 - F.col("area")), 6).alias("auc"))


def evaluate(df: DataFrame, features: list[str], label: str, hue: list[str] | None = None, bins: int = 10) -> DataFrame:
    """(hue, feature, iv, ks, auc); bins are fitted within each hue."""
    keys = [*(hue or []), "feature"]
    counts = value_counts(df, features, label, hue)
    sizes = group_sizes(counts, keys)
    return information_value(counts, keys, bins, sizes).join(ks_auc(counts, keys, sizes[0]), keys)


def null_woe(df: DataFrame, feature: str, label: str, least: float = 0.01) -> DataFrame:
    """WOE of missing values from counts that a share ``least`` of rows is added to."""
    n, m = F.count("*"), F.avg(F.col(label).cast("double"))
    missing = F.col(feature).isNull()
    out = df.agg(F.count(F.when(missing & (F.col(label) > 0), 1)).alias("pos"), F.count(F.when(missing & (F.col(label) == 0), 1)).alias("neg"), F.floor(n * m * least).alias("pos0"), F.floor(n * (1 - m) * least).alias("neg0"))
    pos, neg = F.col("pos") + F.col("pos0"), F.col("neg") + F.col("neg0")
    return out.select("pos", "neg", F.round(F.when(pos == 0, -20.0).when(neg == 0, 20.0).otherwise(F.ln(pos / neg)), 6).alias("woe"))


def chi2_rules(df: DataFrame, rules: list[str], label: str, exact: bool = False) -> DataFrame:
    """Hits, rates, the chi-square statistic of binary rules against a label, and with ``exact`` its p value, unrounded.

    The statistic compares the events and non-events among hits with what the
    classes' shares let expect.
    """
    rows = long_form(df, rules, "int", [label])
    y = (F.col(label) > 0).cast("int")
    a = rows.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("hits"), F.sum(F.col("value") * y).alias("hit_events"), F.sum(y).alias("events"))
    share = F.col("events") / F.col("n")
    e1, e0 = share * F.col("hits"), (1 - share) * F.col("hits")
    o1, o0 = F.col("hit_events"), F.col("hits") - F.col("hit_events")
    stat = F.try_divide((o1 - e1) * (o1 - e1), e1) + F.try_divide((o0 - e0) * (o0 - e0), e0)
    if exact:
        return a.select(F.col("feature").alias("rule"), "hits", stat.alias("chi2"), chi2_p(stat).alias("p"))
    return a.select(F.col("feature").alias("rule"), "hits", F.round(F.col("hits") / F.col("n"), 6).alias("hit_ratio"), F.round(F.try_divide("hit_events", "hits"), 6).alias("hit_rate"), F.round(F.try_divide(F.col("events") - F.col("hit_events"), F.col("n") - F.col("hits")), 6).alias("other_rate"), F.round(share, 6).alias("rate"), F.round(stat, 4).alias("chi2"))


def foil_gains(df: DataFrame, conditions: dict[str, str], label: str, least: int = 100) -> DataFrame:
    """FOIL gain of adding each condition (name: SQL) to the empty rule, all in one pass."""
    y = F.col(label) > 0
    sums = [F.count_if(F.expr(c) & y).alias(f"p_{n}") for n, c in conditions.items()] + [F.count_if(F.expr(c) & ~y).alias(f"n_{n}") for n, c in conditions.items()]
    one = df.agg(F.count_if(y).alias("p"), F.count_if(~y).alias("q"), *sums)
    rows = one.select("p", "q", F.explode(F.array(*(F.struct(F.lit(n).alias("condition"), F.col(f"p_{n}").alias("p1"), F.col(f"n_{n}").alias("n1")) for n in conditions))).alias("c"))
    d0, d1 = F.col("p") / (F.col("p") + F.col("q")), F.try_divide(F.col("c.p1"), F.col("c.p1") + F.col("c.n1"))
    gain = F.when(F.col("c.p1") < least, -10000.0).otherwise(F.log10("c.p1") * (d1 - d0))
    return rows.select("c.condition", "c.p1", "c.n1", F.round(gain, 6).alias("gain"))
