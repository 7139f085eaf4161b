"""Queries of plug-in statistics and parsers, sketches, records, the field-aware machine, chosen rounds, several classes and wide frames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.operators import curves, ffm, history, labels, models, monitor, profile, rules, structure, univariate
from ledgerlens.operators.weights import weighed
from ledgerlens.plans.base import SQL, register
from ledgerlens.plans.extended import _IDS, _edges, _frame, _late
from ledgerlens.plans.frames import NUMERIC, events, lines
from ledgerlens.plans.frames import history as loans
from ledgerlens.session import scratch, table
from ledgerlens.sources import files, records

H = "h AS (SELECT o_orderkey, o_custkey, finish, o_orderdate::date + 30 AS expected FROM orders JOIN (SELECT l_orderkey AS o_orderkey, max(l_shipdate)::date AS finish FROM lineitem GROUP BY 1) USING (o_orderkey))"
HR = "r AS (SELECT o_custkey, (finish - expected)::bigint AS overdue_days, row_number() OVER (PARTITION BY o_custkey ORDER BY finish DESC, o_orderkey) AS place FROM h)"

# --- parsers and statistics of one's own -----------------------------------------------------------------------------


def _with_sizes(text: str | None) -> Iterator[tuple[str, float | None]]:
    """The numbers of a JSON object, and how many fields it has; null of a null text."""
    found = None if text is None else list(monitor.numbers_of(text))
    yield from found or ()
    yield "n_fields", None if found is None else float(len(found))


@register("SELECT event_id, k AS feature, try_cast(json_extract_string(props, '$.' || k) AS double) AS value FROM events, LATERAL (SELECT unnest(json_keys(props)) AS k) t UNION ALL SELECT event_id, 'n_fields', len(json_keys(props))::double FROM events")
def custom_features(spark, d):
    return monitor.parse_with(table(spark, d, "events"), "props", ["event_id"], _with_sizes, nulls=True)


def _quantile(share: float):
    def upper(x: Column) -> Column:
        return F.round(F.percentile(x, F.lit(share)), 6)

    return upper


@register("WITH x AS (SELECT event_type, ts::date::varchar AS day, list_sort(list(value)) AS v FROM events GROUP BY 1, 2) SELECT event_type, day, round(list_avg(v[floor(len(v) * 0.1::double)::int + 1:len(v) - floor(len(v) * 0.1::double)::int]), 6) AS trimmed, round(quantile_cont(e.value, 0.9), 6) AS q90 FROM x JOIN (SELECT event_type, ts::date::varchar AS day, value FROM events) e USING (event_type, day) GROUP BY event_type, day, v")
def custom_stats_by_day(spark, d):
    found = monitor.aggregated(events(spark, d), ["event_type", "day"], "value", {"q90": _quantile(0.9), "trimmed": monitor.trimmed_mean(0.1)})
    return found.withColumn("trimmed", F.round("trimmed", 6))


@register(f"WITH {H}, {HR} SELECT o_custkey, round(quantile_cont(CASE WHEN place <= 3 THEN overdue_days END, 0.9), 6) AS overdue_days_3_q90, round(quantile_cont(overdue_days, 0.9), 6) AS overdue_days_all_q90 FROM r GROUP BY 1")
def custom_history_stats(spark, d):
    ranked = history.ranked_history(loans(spark, d), "o_custkey", "created", "finish", "expected", "o_orderkey")
    made = history.HistoryFeatures("o_custkey", [3, None], smooth=False, columns=("overdue_days",), statistics={"q90": _quantile(0.9)}).fit(ranked)
    return made.transform(ranked, clocks=False).select("o_custkey", "overdue_days_3_q90", "overdue_days_all_q90")


@register("WITH s AS (SELECT user_id, datediff('second', lag(ts) OVER w, ts) AS raw, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(quantile_cont(us // 1000000, 0.9), 6)::double AS q90 FROM s GROUP BY 1")
def custom_span_stats(spark, d):
    return history.time_spans(table(spark, d, "events"), "user_id", "ts", tie="event_id", statistics={"q90": _quantile(0.9)}).select("user_id", "q90")


@register("SELECT event_type, count(*) AS n, true AS distinct_near, true AS quantiles_near FROM events GROUP BY 1")
def sketch_by_day(spark, d):
    """Sketches of each day, merged to the whole span, within their bounds of the exact answers: 5 % of distinct users and values, 1.5 % of ranks."""
    e = events(spark, d)
    shares = [0.1, 0.5, 0.9]
    whole = monitor.merged_sketches(monitor.sketches_by_time(e, ["event_type", "day"], "value"), ["event_type"], shares)
    met = e.select("event_type", "value").join(whole, "event_type")
    ranks = [F.avg((F.col("value") <= F.get("quantiles", F.lit(i))).cast("double")) for i in range(len(shares))]
    exact = F.count_distinct("value")
    near = F.lit(True)
    for r, p in zip(ranks, shares, strict=True):
        near = near & (F.abs(r - p) <= 0.015 + 1 / F.count("*"))
    return met.groupBy("event_type").agg(F.count("*").alias("n"), (F.abs(F.max("distinct") - exact) <= 0.05 * exact).alias("distinct_near"), near.alias("quantiles_near"))


# --- records ---------------------------------------------------------------------------------------------------------


@register("SELECT c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer")
def record_source(spark, d):
    c, path = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")), scratch(spark, "records")
    records.write_framed(c, path)
    return records.read_framed(spark, path, "c_custkey long, c_name string, c_acctbal double, segment string")


@register("SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def catalogue_append(spark, d):
    """A file made a table of the catalogue, and a second one appended to it."""
    s, name, where = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), f"uploaded_{uuid.uuid4().hex}", scratch(spark, "uploaded")
    for rows, anew in ((s, True), (s.where("s_suppkey % 2 = 0"), False)):
        path = f"{scratch(spark, 'upload')}.csv"
        rows.write.option("header", True).csv(path)
        files.table_from_file(spark, name, path, overwrite=anew, location=where)
    # The rows stay at their location.
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema("s_suppkey long, s_name string, s_acctbal string").parquet(where).withColumn("s_acctbal", F.col("s_acctbal").cast("double"))


# --- rules over ordered categories -----------------------------------------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register(
    "WITH o AS (SELECT *, (o_totalprice > 100000)::int AS big FROM orders), ways AS (SELECT unnest(['>=', '<=']) AS op) "
    "SELECT 'o_orderpriority' AS feature, op, o_orderpriority AS text, NULL::double AS number FROM (SELECT DISTINCT o_orderpriority FROM o), ways "
    "UNION ALL SELECT 'o_orderstatus', unnest(['==', '!=']), o_orderstatus, NULL FROM (SELECT DISTINCT o_orderstatus FROM o) "
    "UNION ALL SELECT 'big', '==', NULL, big FROM (SELECT DISTINCT big FROM o) "
    "UNION ALL SELECT 'o_totalprice', op, NULL, round(number, 4) FROM (SELECT DISTINCT unnest(quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS number FROM o), ways"
)
def rule_conditions(spark, d):
    """The conditions that rules are made of: of an ordered category, a text, two values and a number."""
    o = table(spark, d, "orders").withColumn("big", (F.col("o_totalprice") > 100000).cast("int"))
    found = rules.conditions(o, ["o_orderpriority", "o_orderstatus", "big", "o_totalprice"], ordered={"o_orderpriority": PRIORITIES})
    return rules.condition_rows(spark, found).withColumn("number", F.round("number", 4))


@register("WITH o AS (SELECT CASE WHEN o_orderpriority <= '2-HIGH' THEN 'soon' WHEN o_orderpriority = '5-LOW' THEN 'late' ELSE 'middle' END AS kind FROM orders) SELECT kind, kind AS predicted, count(*) AS n FROM o GROUP BY 1")
def ripper_ordered(spark, d):
    """Classes that are ranges of an ordered category: the rules learned among it, a text and a number meet them in every row."""
    kind = F.when(F.col("o_orderpriority") <= "2-HIGH", "soon").when(F.col("o_orderpriority") == "5-LOW", "late").otherwise("middle")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", kind.alias("kind"))
    learned = rules.Ripper(ordered={"o_orderpriority": PRIORITIES}).fit(o, "kind", ["o_orderstatus", "o_totalprice", "o_orderpriority"], ["o_orderkey"])
    return learned.predict(o).groupBy("kind", "predicted").agg(F.count("*").alias("n"))


# --- tables of a feature, given cuts, data sets ------------------------------------------------------------------------


@register("WITH x AS (SELECT nullif(l_discount, 0.0) AS x, (l_returnflag = 'R')::int AS y FROM lineitem), q AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM x), b AS (SELECT CASE WHEN x IS NULL THEN 0 WHEN x <= lo THEN 1 WHEN x >= hi THEN 12 ELSE ceil((x - lo) / ((hi - lo) / 10)) + 1 END::bigint AS bin, x, y FROM x, q), g AS (SELECT bin, count(*) AS n, sum(y) AS bad, avg(x) AS m FROM b GROUP BY 1), t AS (SELECT *, sum(bad) OVER () AS b, sum(n - bad) OVER () AS g FROM g) SELECT bin, n, bad::bigint AS bad, round(m, 4) AS mean, round(ln((g / b) * (bad + 1) / (n - bad + 1)), 6) AS woe, coalesce(nullif(round((bad / b - (n - bad) / g) * ln((g / b) * (bad + 1) / (n - bad + 1)), 6), 0.0), 0.0) AS iv FROM t")
def null_bin(spark, d):
    return univariate.continuous_table(lines(spark, d), "discount_or_null", "y")


@register("WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM lineitem WHERE l_linenumber <= 3), g AS (SELECT len(list_filter(q[2:len(q) - 1], lambda v: v < l_extendedprice)) + 1 AS band, count(*) AS n, sum((l_returnflag = 'R')::int) AS bad FROM lineitem, e WHERE l_linenumber > 3 GROUP BY 1) SELECT band::bigint AS band, n, round(bad / n, 6) AS rate, round(sum(bad) OVER w / sum(n) OVER w, 6) AS acc_rate, round(sum(n - bad) OVER w / sum(n - bad) OVER (), 6) AS acc_recall_good, round(sum(bad) OVER w / sum(bad) OVER (), 6) AS acc_recall_bad, round(sum(n) OVER w / sum(n) OVER (), 6) AS acc_pass FROM g WINDOW w AS (ORDER BY band)")
def score_bands_of_training(spark, d):
    """Bands that the training rows give, on the others."""
    x = lines(spark, d)
    cuts = curves.band_cuts(x.where("l_linenumber <= 3"), "l_extendedprice", "y")
    return curves.score_bands(x.where("l_linenumber > 3"), "l_extendedprice", "y", cuts=cuts)


@register("SELECT 'urgent' AS dataset, count(*) AS n, 0::bigint AS missing, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'rest', count(*), 0, round(avg(o_totalprice), 4) FROM orders WHERE o_orderpriority <> '1-URGENT'")
def profile_of_two(spark, d):
    o = table(spark, d, "orders").select("o_totalprice", "o_orderpriority")
    found = structure.datasets_profile({"urgent": o.where("o_orderpriority = '1-URGENT'"), "rest": o.where("o_orderpriority <> '1-URGENT'")}, ["o_totalprice"])["numeric"]
    return found.select("dataset", F.col("num_non_missing").alias("n"), F.col("num_missing").alias("missing"), F.round("mean", 4).alias("mean"))


@register("SELECT * FROM (VALUES ('l_quantity', 'l_quantity'), ('l_extendedprice', 'l_extendedprice'), ('l_discount', 'l_discount'), ('l_tax', 'l_tax'), ('x3', 'l_quantity'), ('x7', 'l_discount'), ('minus', 'l_tax'), ('near', 'near')) t(feature, same_as)")
def wide_duplicates(spark, d):
    x = table(spark, d, "lineitem").select(*NUMERIC, (F.col("l_quantity") * 3).alias("x3"), (F.col("l_discount") * 0.7).alias("x7"), (-F.col("l_tax")).alias("minus"), F.when(F.col("l_linenumber") == 5, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("near"))
    found = profile.duplicate_groups(x, x.columns)
    return spark.createDataFrame(list(found.items()), "feature string, same_as string")


_OF_LABEL = "SELECT '{0}' AS label, feature, coalesce(bin, -2)::bigint AS bin, count({0}) AS n, coalesce(sum(({0} > 0)::int), 0)::bigint AS positives FROM b GROUP BY feature, bin HAVING count({0}) > 0"


@register(
    "WITH x AS (SELECT f AS feature, v, (l_returnflag = 'R')::int AS y, CASE WHEN l_linestatus = 'O' THEN (l_returnflag = 'R')::int END AS late FROM lineitem, LATERAL (VALUES ('l_extendedprice', l_extendedprice), ('discount_or_null', nullif(l_discount, 0.0))) t(f, v)), "
    f"e AS ({_edges('v', 'x WHERE late IS NOT NULL', 'feature')}), s AS (SELECT DISTINCT feature, v FROM x WHERE late IS NOT NULL), "
    "b AS (SELECT x.feature, CASE WHEN s.feature IS NULL THEN NULL WHEN x.v IS NULL THEN -1 ELSE len(list_filter(e, lambda z: z < x.v)) END AS bin, y, late FROM x JOIN e USING (feature) LEFT JOIN s ON s.feature = x.feature AND s.v IS NOT DISTINCT FROM x.v) "
    f"{_OF_LABEL.format('y')} UNION ALL {_OF_LABEL.format('late')}"
)
def reused_splits(spark, d):
    """Bins of values that open lines hold, applied to all lines; those of other values, unseen, are bin -2 here."""
    return labels.reused_splits(_late(spark, d), ["l_extendedprice", "discount_or_null"], ["y", "late"], "late").fillna(-2, ["bin"])


@register(f"SELECT event_type, feature, day, 'ks' AS figure, ks AS drift, volume FROM ({SQL['json_feature_stats']}) UNION ALL SELECT event_type, 'value', day, 'psi', psi, volume FROM ({SQL['psi_by_day']})")
def monitor_whole(spark, d):
    """All of a deployed model's drift by day: PSI of its score and KS of the features in its JSON column."""
    found = monitor.monitor(events(spark, d), "event_type", "value", "props", "bench", "day", "passed")
    stats = found["features"].select("event_type", "feature", "day", F.lit("ks").alias("figure"), F.col("ks").alias("drift"), "volume")
    return stats.union(found["psi"].select("event_type", F.lit("value"), "day", F.lit("psi"), "psi", "volume"))


# --- models ----------------------------------------------------------------------------------------------------------


@register()
def ffm_machine(spark, d):
    """A field-aware machine on quantity and price in twentieths and tax, by training, validation and test rows."""
    x = _frame(spark, d)
    token = lambda field, value: F.concat(F.lit(f"{field}:"), (F.lit(1000 * field) + value).cast("int").cast("string"), F.lit(":1"))
    line = F.concat_ws(" ", "big", token(0, F.floor(F.col("l_quantity") / 2.5)), token(1, F.floor(F.col("l_extendedprice") / 2500)), token(2, F.round(F.col("l_tax") * 100)))
    part = F.pmod(F.xxhash64(*_IDS), F.lit(10))
    # 0: training, 1: validation, 2: test.
    rows = weighed(x.select("big", line.alias("line"), F.when(part < 7, 0).when(part == 7, 1).otherwise(2).alias("part")), ["big", "line", "part"])
    train, valid, test = (rows.where(F.col("part") == i).drop("part") for i in range(3))
    machine, _ = ffm.ffm_fit(train, valid, buckets=1 << 12, count="_n")
    return models.figures(ffm.ffm_scores(machine, test), "big", "_n", part="test")


@register()
def gbt_rounds(spark, d):
    """Boosted trees with the rounds that five folds choose: figures of folds and of the refit."""
    return models.boosted_rounds(_frame(spark, d), ["l_quantity", "l_extendedprice", "l_tax"], "big", _IDS, rounds=15, maxDepth=4, seed=7)[3]


@register("SELECT o_orderstatus, count(*) AS n, count(*) AS predicted, count(*) AS sums_to_one FROM orders GROUP BY 1")
def class_cv(spark, d):
    """Scores of three classes: every row is predicted once, by probabilities that sum up to one."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double").alias("days"))
    found, _ = models.class_scores(o, ["o_totalprice", "days"], "o_orderstatus", ["o_orderkey"], folds=3, maxIter=30)
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + x)
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("predicted").alias("predicted"), F.count_if(F.abs(total - 1) < 1e-6).alias("sums_to_one"))

