"""All registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import stats
from ledgerlens.operators import binning, curves, encode, evaluate, history, models, monitor, profile, ranks, rules, split, univariate
from ledgerlens.plans.base import QUERIES, SQL, register
from ledgerlens.plans.frames import NUMERIC, events, lines
from ledgerlens.plans.frames import history as loans
from ledgerlens.session import table
from ledgerlens.sources import files

L = "l AS (SELECT *, (l_returnflag = 'R')::int AS y, nullif(l_discount, 0.0) AS discount_or_null FROM lineitem)"
LONG = "long AS (SELECT l_linestatus, y, f AS feature, v AS value FROM l, LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice), ('l_discount', l_discount), ('l_tax', l_tax)) t(f, v))"
EDGES = "edges AS (SELECT feature, list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS q FROM long GROUP BY 1), inner_edges AS (SELECT feature, list_sort(q)[2:len(q) - 1] AS e FROM edges)"
BINS = "binned AS (SELECT long.*, len(list_filter(e, lambda x: x < value)) AS bin FROM long JOIN inner_edges USING (feature))"
WOE = "CASE WHEN p = 0 THEN -20.0 WHEN q = 0 THEN 20.0 ELSE ln((p / pa) / (q / qa)) END"
EV = "e AS (SELECT *, ts::date::varchar AS day, ts < TIMESTAMP '2024-01-11' AS bench, (event_type = 'purchase' OR value > 50)::int AS passed FROM events)"
H = "h AS (SELECT o_orderkey, o_custkey, o_orderdate::date AS created, finish, o_orderdate::date + 30 AS expected FROM orders JOIN (SELECT l_orderkey AS o_orderkey, max(l_shipdate)::date AS finish FROM lineitem GROUP BY 1) USING (o_orderkey))"
HR = "r AS (SELECT *, (finish - expected)::bigint AS overdue_days, rank() OVER (PARTITION BY o_custkey ORDER BY finish DESC) + (count(*) OVER (PARTITION BY o_custkey, finish) - 1) / 2 AS nth, row_number() OVER (PARTITION BY o_custkey ORDER BY finish DESC, o_orderkey) AS place, (coalesce(lag(created) OVER (PARTITION BY o_custkey ORDER BY created DESC, o_orderkey), max(created) OVER (PARTITION BY o_custkey)) - finish)::bigint AS gap_days FROM h)"
COUNTS = "c AS (SELECT feature, value, sum(y) AS pos, count(*) - sum(y) AS neg FROM long GROUP BY 1, 2)"
RUN = "run AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER f AS p, sum(neg) OVER f AS n FROM c WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature))"


# --- univariate tables -----------------------------------------------------------------------------------------------


@register(f"WITH {L}, {LONG}, {EDGES}, {BINS}, g AS (SELECT bin, sum(y)::double AS p, (count(*) - sum(y))::double AS q FROM binned WHERE feature = 'l_extendedprice' GROUP BY 1), t AS (SELECT *, sum(p) OVER () AS pa, sum(q) OVER () AS qa FROM g) SELECT 'l_extendedprice' AS feature, bin::bigint AS bin, p::bigint AS pos, q::bigint AS neg, round({WOE}, 6) AS woe, round((p / pa - q / qa) * ({WOE}), 6) AS iv FROM t")
def woe_qcut(spark, d):
    counts = evaluate.value_counts(lines(spark, d), ["l_extendedprice"], "y")
    return evaluate.woe_table(evaluate.binned(counts, ["feature"]), ["feature"], "bin")


@register(f"WITH {L} SELECT count(*) AS n, sum(y)::bigint AS bad, (count(*) - sum(y))::bigint AS good, round(avg(y), 6) AS rate FROM l")
def overall_overdue(spark, d):
    return lines(spark, d).agg(F.count("*").alias("n"), F.sum("y").alias("bad"), F.count_if(F.col("y") == 0).alias("good"), F.round(F.avg("y"), 6).alias("rate"))


@register("WITH o AS (SELECT o_orderpriority AS value, sum((o_orderstatus = 'F')::int)::double AS bad, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT *, sum(bad) OVER () AS b, sum(n - bad) OVER () AS g, sum(n) OVER () AS total FROM o) SELECT value, n, bad::bigint AS bad, round_even(100 * bad / n / (b / total), 0) AS idx, round(100.0 * n / total, 3) AS share, round(100 * bad / n, 3) AS rate, round(ln((bad / b) / ((n - bad) / g)), 6) AS woe, round((bad / b - (n - bad) / g) * ln((bad / b) / ((n - bad) / g)), 6) AS iv FROM t")
def discrete_iv(spark, d):
    return univariate.discrete_table(table(spark, d, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int")), "o_orderpriority", "y")


@register("WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem), b AS (SELECT CASE WHEN l_extendedprice <= lo THEN 1 WHEN l_extendedprice >= hi THEN 12 ELSE ceil((l_extendedprice - lo) / ((hi - lo) / 10)) + 1 END::bigint AS bin, l_extendedprice AS x, (l_returnflag = 'R')::int AS y FROM lineitem, q), g AS (SELECT bin, count(*) AS n, sum(y) AS bad, avg(x) AS m FROM b GROUP BY 1), t AS (SELECT *, sum(bad) OVER () AS b, sum(n - bad) OVER () AS g FROM g) SELECT bin, n, bad::bigint AS bad, round(m, 4) AS mean, round(ln((g / b) * (bad + 1) / (n - bad + 1)), 6) AS woe, round((bad / b - (n - bad) / g) * ln((g / b) * (bad + 1) / (n - bad + 1)), 6) AS iv FROM t")
def continuous_bins(spark, d):
    return univariate.continuous_table(lines(spark, d), "l_extendedprice", "y")


# --- profiles --------------------------------------------------------------------------------------------------------

_DESC = ["l_returnflag", "l_linestatus", "discount_or_null", "l_linenumber"]


@register(f"WITH {L}, v AS (SELECT f, v FROM l, LATERAL (VALUES ('l_returnflag', l_returnflag), ('l_linestatus', l_linestatus), ('discount_or_null', discount_or_null::varchar), ('l_linenumber', l_linenumber::varchar)) t(f, v)), c AS (SELECT f, v, count(*) AS n FROM v GROUP BY 1, 2) SELECT f AS feature, coalesce(sum(n) FILTER (v IS NULL), 0)::bigint AS null_num, coalesce(sum(n) FILTER (v IS NOT NULL), 0)::bigint AS notnull_num, round(coalesce(sum(n) FILTER (v IS NOT NULL), 0) / sum(n), 6) AS notnull_ratio, count(v) AS diff_values_num, coalesce(max(n) FILTER (v IS NOT NULL), sum(n))::bigint AS most_value_num, round(coalesce(max(n) FILTER (v IS NOT NULL), sum(n)) / sum(n), 6) AS same_ratio FROM c GROUP BY 1")
def desc_columns(spark, d):
    return profile.describe_columns(lines(spark, d), _DESC)


@register(f"WITH {L}, t AS (SELECT 1.0 AS dataset, avg((discount_or_null IS NOT NULL)::int) AS a, 1.0 AS b FROM l) SELECT 'dataset' AS feature, round(dataset, 6)::double AS coverage, NULL::double AS saturation FROM t UNION ALL SELECT 'discount_or_null', round(a, 6), round(a / dataset, 6) FROM t UNION ALL SELECT 'l_tax', round(b, 6), round(b / dataset, 6) FROM t")
def coverage(spark, d):
    return profile.coverage(lines(spark, d), ["discount_or_null", "l_tax"])


@register(f"WITH {L}, {LONG} SELECT feature, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS least, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS greatest, round(avg((value IS NULL)::int), 6) AS missing, round(any_value(same) / count(*), 6) AS same FROM long JOIN (SELECT feature, max(n) AS same FROM (SELECT feature, value, count(*) AS n FROM long GROUP BY ALL) GROUP BY 1) s USING (feature) GROUP BY 1")
def describe(spark, d):
    return profile.numeric_summary(lines(spark, d), NUMERIC)


@register("SELECT f AS feature, n AS n_distinct, CASE WHEN n > 20 THEN 'continuous' ELSE 'discrete' END AS kind FROM (SELECT count(DISTINCT l_quantity) AS l_quantity, count(DISTINCT l_tax) AS l_tax, count(DISTINCT l_returnflag) AS l_returnflag FROM lineitem) UNPIVOT (n FOR f IN (l_quantity, l_tax, l_returnflag))")
def kinds(spark, d):
    return profile.kinds(table(spark, d, "lineitem"), ["l_quantity", "l_tax", "l_returnflag"])


@register("SELECT 'c_name' AS feature, 'distinct' AS reason UNION ALL SELECT 'all_null', 'missing' UNION ALL SELECT 'one', 'same'")
def prune_list(spark, d):
    c = table(spark, d, "customer").select("c_name", "c_mktsegment", "c_nationkey", F.lit(None).cast("string").alias("all_null"), F.lit("a").alias("one"))
    return profile.prune_list(c, c.columns, numeric={"c_nationkey"})


@register("SELECT 'l_discount' AS left_column, 'twice' AS right_column, true AS duplicate UNION ALL SELECT 'l_discount', 'l_tax', false UNION ALL SELECT 'twice', 'l_tax', false")
def dup_columns(spark, d):
    x = table(spark, d, "lineitem").select("l_discount", (F.col("l_discount") * 2).alias("twice"), "l_tax")
    return profile.duplicate_columns(x, ["l_discount", "twice", "l_tax"])


@register("SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def dedup(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").dropDuplicates()


@register("SELECT coalesce(o_orderpriority, 'All') AS segment, round(avg((o_orderstatus = 'F')::int), 6) AS rate, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority)")
def target_by_segment(spark, d):
    return profile.target_by_segment(table(spark, d, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int")), "y", "o_orderpriority")


@register(f"WITH {L}, {LONG}, e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1), b AS (SELECT feature, least(9, floor((value - lo) / ((hi - lo) / 10)))::bigint AS bucket, count(*) AS n FROM long JOIN e USING (feature) GROUP BY 1, 2) SELECT e.feature, i::bigint AS bucket, round(lo, 6) AS lo0, round((hi - lo) / 10, 6) AS width, coalesce(n, 0)::bigint AS n FROM e CROSS JOIN range(10) t(i) LEFT JOIN b ON b.feature = e.feature AND b.bucket = i")
def hist_standard(spark, d):
    return profile.histogram(lines(spark, d), NUMERIC)


@register(f"WITH {L}, {LONG}, q AS (SELECT feature, quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q, count(*) AS n FROM long GROUP BY 1) SELECT feature, i::bigint AS bucket, round(q[i + 1], 6) AS low, round(q[i + 2], 6) AS high, n / 10 AS sample_count FROM q CROSS JOIN range(10) t(i)")
def hist_quantiles(spark, d):
    return profile.quantile_buckets(lines(spark, d), NUMERIC)


@register("WITH c AS (SELECT 'lang' AS feature, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2) SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value DESC) - 1 AS rank FROM c WHERE value IS NOT NULL")
def rank_hist(spark, d):
    return profile.rank_histogram(table(spark, d, "documents"), ["lang", "source"])


@register("SELECT label::bigint AS label, count(*) AS n, min(len(embedding))::bigint AS least_len, max(len(embedding))::bigint AS most_len, sum(len(embedding))::bigint AS n_values FROM embeddings GROUP BY 1")
def array_profile(spark, d):
    size = F.size("embedding").cast("long")
    return table(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), F.min(size).alias("least_len"), F.max(size).alias("most_len"), F.sum(size).alias("n_values"))


# --- bins, woe, evaluation -------------------------------------------------------------------------------------------


@register(f"WITH {L}, {LONG}, e AS (SELECT feature, min(value) AS a, max(value) AS b FROM long GROUP BY 1) SELECT feature, i::bigint AS i, round(a + i * (b - a) / 10, 6) AS edge FROM e CROSS JOIN range(1, 10) t(i)")
def cut_bins(spark, d):
    e = binning.edges_of(profile.long_form(lines(spark, d), NUMERIC, "double"), ["feature"], "cut")
    return e.select("feature", F.posexplode("edges").alias("i", "edge")).select("feature", (F.col("i") + 1).cast("long").alias("i"), F.round("edge", 6).alias("edge"))


@register(f"WITH {L}, {LONG}, {EDGES} SELECT feature, i::bigint AS i, round(e[i], 6) AS edge FROM inner_edges CROSS JOIN range(1, 11) t(i) WHERE i <= len(e)")
def qcut_bins(spark, d):
    e = binning.edges_of(profile.long_form(lines(spark, d), NUMERIC, "double"), ["feature"])
    return e.select("feature", F.posexplode("edges").alias("i", "edge")).select("feature", (F.col("i") + 1).cast("long").alias("i"), F.round("edge", 6).alias("edge"))


@register(f"WITH {L}, {LONG}, {EDGES}, {BINS} SELECT feature, bin::bigint AS bin, count(*) AS n FROM binned GROUP BY 1, 2")
def bin_assign(spark, d):
    long = profile.long_form(lines(spark, d), NUMERIC, "double")
    return binning.assign(long, binning.edges_of(long, ["feature"]), ["feature"]).groupBy("feature", "bin").agg(F.count("*").alias("n"))


@register("""
WITH RECURSIVE v AS (SELECT l_quantity AS value, count(*)::bigint AS n, row_number() OVER (ORDER BY l_quantity) AS i FROM lineitem GROUP BY 1),
tries AS (SELECT b, CASE b WHEN 11 THEN ceil(t / 11) + 1 ELSE ceil(t / b) END AS least FROM range(10, 120) r(b), (SELECT sum(n) AS t FROM v)),
fold AS (
  SELECT b, least, i, value, n AS held, 0 AS grp, n >= least AS closed FROM tries, v WHERE i = 1
  UNION ALL
  SELECT f.b, f.least, v.i, v.value, CASE WHEN f.closed THEN v.n ELSE f.held + v.n END, CASE WHEN f.closed THEN f.grp + 1 ELSE f.grp END, CASE WHEN f.closed THEN v.n ELSE f.held + v.n END >= f.least
  FROM fold f JOIN v ON v.i = f.i + 1),
sizes AS (SELECT b, max(grp) + 1 AS k FROM fold GROUP BY 1),
chosen AS (SELECT coalesce((SELECT max(b) FROM sizes WHERE b > 10 AND b < coalesce((SELECT min(b) FROM sizes WHERE b > 10 AND k > 10), 1000)), 10) AS b)
SELECT grp::bigint AS grp, min(value) AS low, max(value) AS high, max(held)::bigint AS n FROM fold WHERE b = (SELECT b FROM chosen) GROUP BY 1
""")
def optimal_split(spark, d):
    counts = lines(spark, d).groupBy(F.col("l_quantity").cast("double").alias("value")).agg(F.count("*").alias("n"))
    return binning.optimal_groups(counts)


_KEYS = ["feature"]


@register(f"WITH {L}, {LONG}, {EDGES}, {BINS}, g AS (SELECT feature, bin, sum(y)::double AS p, (count(*) - sum(y))::double AS q FROM binned GROUP BY 1, 2), t AS (SELECT *, sum(p) OVER (PARTITION BY feature) AS pa, sum(q) OVER (PARTITION BY feature) AS qa FROM g) SELECT feature, round(sum((p / pa - q / qa) * ({WOE})), 6) AS iv FROM t GROUP BY 1")
def iv_matrix(spark, d):
    return evaluate.information_value(evaluate.value_counts(lines(spark, d), NUMERIC, "y"), _KEYS)


@register(f"WITH {L}, {LONG}, {COUNTS}, {RUN} SELECT feature, round(max(abs(cp / p - cn / n)), 6) AS ks, round(greatest(sum(pos * (cn - neg / 2)) / max(p::double * n), 1 - sum(pos * (cn - neg / 2)) / max(p::double * n)), 6) AS auc FROM run GROUP BY 1")
def ks_auc_matrix(spark, d):
    return evaluate.ks_auc(evaluate.value_counts(lines(spark, d), NUMERIC, "y"), _KEYS)


_EH = EDGES.replace("feature, list_distinct", "l_linestatus, feature, list_distinct").replace("GROUP BY 1)", "GROUP BY 1, 2)").replace("SELECT feature, list_sort", "SELECT l_linestatus, feature, list_sort")
_BH = BINS.replace("USING (feature)", "USING (l_linestatus, feature)")
_CH = COUNTS.replace("SELECT feature", "SELECT l_linestatus, feature").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3")
_RH = RUN.replace("PARTITION BY feature", "PARTITION BY l_linestatus, feature")


@register(f"WITH {L}, {LONG}, {_EH}, {_BH}, g AS (SELECT l_linestatus, feature, bin, sum(y)::double AS p, (count(*) - sum(y))::double AS q FROM binned GROUP BY 1, 2, 3), t AS (SELECT *, sum(p) OVER (PARTITION BY l_linestatus, feature) AS pa, sum(q) OVER (PARTITION BY l_linestatus, feature) AS qa FROM g), i AS (SELECT l_linestatus, feature, round(sum((p / pa - q / qa) * ({WOE})), 6) AS iv FROM t GROUP BY 1, 2), {_CH}, {_RH}, k AS (SELECT l_linestatus, feature, round(max(abs(cp / p - cn / n)), 6) AS ks, round(greatest(sum(pos * (cn - neg / 2)) / max(p::double * n), 1 - sum(pos * (cn - neg / 2)) / max(p::double * n)), 6) AS auc FROM run GROUP BY 1, 2) SELECT l_linestatus, feature, iv, ks, auc FROM i JOIN k USING (l_linestatus, feature)")
def feature_eval_hue(spark, d):
    return evaluate.evaluate(lines(spark, d), NUMERIC, "y", ["l_linestatus"])


@register(f"WITH {L}, a AS (SELECT count(*) FILTER (discount_or_null IS NULL AND y = 1) AS pos, count(*) FILTER (discount_or_null IS NULL AND y = 0) AS neg, floor(count(*) * avg(y) * 0.01) AS pos0, floor(count(*) * (1 - avg(y)) * 0.01) AS neg0 FROM l) SELECT pos, neg, round(ln((pos + pos0) / (neg + neg0)), 6) AS woe FROM a")
def nan_woe(spark, d):
    return evaluate.null_woe(lines(spark, d), "discount_or_null", "y")


@register(f"WITH {L}, g AS (SELECT l_linestatus || chr(1) || l_linenumber AS value, sum(y)::double AS p, (count(*) - sum(y))::double AS q FROM l GROUP BY 1), t AS (SELECT *, sum(p) OVER () AS pa, sum(q) OVER () AS qa FROM g) SELECT round(sum((p / pa - q / qa) * ({WOE})), 6) AS iv FROM t")
def combined_iv(spark, d):
    from pyspark.sql import Window

    y = F.col("y") > 0
    g = lines(spark, d).groupBy(F.concat_ws("\x01", "l_linestatus", "l_linenumber").alias("value")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("q"))
    w = Window.partitionBy()
    t = g.select(stats.iv_part(F.col("p"), F.col("q"), F.sum("p").over(w), F.sum("q").over(w)).alias("x"))
    return t.agg(F.round(F.sum("x"), 6).alias("iv"))


@register(f"WITH {L}, r AS (SELECT 'big' AS rule, (l_quantity > 40)::int AS c, y FROM l UNION ALL SELECT 'cheap', (l_discount >= 0.05)::int, y FROM l UNION ALL SELECT 'untaxed', (l_tax = 0)::int, y FROM l), a AS (SELECT rule, count(*)::double AS n, sum(c)::double AS hits, sum(c * y)::double AS hit_events, sum(y)::double AS events FROM r GROUP BY 1) SELECT rule, hits::bigint AS hits, round(hits / n, 6) AS hit_ratio, round(hit_events / hits, 6) AS hit_rate, round((events - hit_events) / (n - hits), 6) AS other_rate, round(events / n, 6) AS rate, round(pow(hit_events - events / n * hits, 2) / (events / n * hits) + pow(hits - hit_events - (1 - events / n) * hits, 2) / ((1 - events / n) * hits), 4) AS chi2 FROM a")
def chi2_rules(spark, d):
    x = lines(spark, d).select("y", (F.col("l_quantity") > 40).cast("int").alias("big"), (F.col("l_discount") >= 0.05).cast("int").alias("cheap"), (F.col("l_tax") == 0).cast("int").alias("untaxed"))
    return evaluate.chi2_rules(x, ["big", "cheap", "untaxed"], "y")


@register(f"WITH {L}, t AS (SELECT sum(y)::double AS p, count(*)::double - sum(y) AS q FROM l), c AS (SELECT 'big' AS condition, sum(y)::double AS p1, count(*)::double - sum(y) AS n1 FROM l WHERE l_quantity > 40 UNION ALL SELECT 'late', sum(y), count(*) - sum(y) FROM l WHERE l_linestatus = 'O') SELECT condition, p1::bigint AS p1, n1::bigint AS n1, round(CASE WHEN p1 < 100 THEN -10000.0 ELSE log10(p1) * (p1 / (p1 + n1) - p / (p + q)) END, 6) AS gain FROM c, t")
def ripper_foil_step(spark, d):
    return evaluate.foil_gains(lines(spark, d), {"big": "l_quantity > 40", "late": "l_linestatus = 'O'"}, "y")


@register(f"WITH {L} SELECT (l_quantity >= 30 AND l_discount <= 0.05) OR (l_linestatus <> 'O') AS hit, count(*) AS n, sum(y)::bigint AS events FROM l GROUP BY 1")
def ripper_predict(spark, d):
    hit = rules.covers([[("l_quantity", ">=", 30), ("l_discount", "<=", 0.05)], [("l_linestatus", "!=", "O")]])
    return lines(spark, d).groupBy(hit.alias("hit")).agg(F.count("*").alias("n"), F.sum("y").alias("events"))


@register()
def ripper_rules(spark, d):
    """A decision list over numbers and texts for classes that hang on two columns, against the true classes."""
    kind = F.when((F.col("l_quantity") > 40) & (F.col("l_tax") <= 0.03), "much").when(F.col("l_quantity") <= 10, "little").otherwise("middle")
    x = lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_linestatus", kind.alias("kind"))
    learned = rules.Ripper().fit(x, "kind", ["l_quantity", "l_tax", "l_linestatus"], ["l_orderkey", "l_linenumber"])
    return learned.predict(x).groupBy("kind", "predicted").agg(F.count("*").alias("n"))


# --- curves ----------------------------------------------------------------------------------------------------------

_X = "x AS (SELECT l_quantity::double AS score, (l_returnflag = 'R')::int AS y FROM lineitem)"
_PX = "p AS (SELECT l_extendedprice AS x, (l_returnflag = 'R')::int AS y FROM lineitem)"


@register(f"WITH {_X}, c AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM x GROUP BY 1), r AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c WINDOW w AS (ORDER BY score DESC)) SELECT score, tp::bigint AS tp, fp::bigint AS fp, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (tp + fp + p), 6) AS f1, round((tp + n - fp) / (p + n), 6) AS accuracy, round(tp / p - fp / n, 6) AS distance FROM r")
def roc_pr_ks_points(spark, d):
    return curves.threshold_points(lines(spark, d), "l_quantity", "y")


@register(f"WITH {_PX}, e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM p), g AS (SELECT len(list_filter(q[2:len(q) - 1], lambda v: v < x)) + 1 AS band, count(*) AS n, sum(y) AS bad FROM p, e GROUP BY 1) SELECT band::bigint AS band, n, round(bad / n, 6) AS rate, round(sum(bad) OVER w / sum(n) OVER w, 6) AS acc_rate, round(sum(n - bad) OVER w / sum(n - bad) OVER (), 6) AS acc_recall_good, round(sum(bad) OVER w / sum(bad) OVER (), 6) AS acc_recall_bad, round(sum(n) OVER w / sum(n) OVER (), 6) AS acc_pass FROM g WINDOW w AS (ORDER BY band)")
def score_bands(spark, d):
    return curves.score_bands(lines(spark, d), "l_extendedprice", "y")


@register(f"WITH {_PX}, e AS (SELECT list_sort(list_distinct(quantile_cont(-x, list_transform(range(51), lambda i: i / 50)))) AS q FROM p), g AS (SELECT len(list_filter(q[2:len(q) - 1], lambda v: v < -x)) + 1 AS band, count(*) AS n, sum(y) AS bad FROM p, e GROUP BY 1) SELECT band::bigint AS band, n, bad::bigint AS bad, round(sum(bad) OVER w / sum(n) OVER w / (sum(bad) OVER () / sum(n) OVER ()), 6) AS lift FROM g WINDOW w AS (ORDER BY band)")
def lift(spark, d):
    return curves.lift(lines(spark, d), "l_extendedprice", "y")


@register("WITH r AS (SELECT row_number() OVER w AS k, sum((l_returnflag = 'R')::int) OVER w AS bad FROM lineitem WINDOW w AS (ORDER BY l_extendedprice, l_orderkey, l_linenumber)), g AS (SELECT i AS pct, floor(i * n / 100)::bigint AS k FROM range(0, 101) t(i), (SELECT count(*) AS n FROM lineitem)), j AS (SELECT pct, g.k, coalesce(bad / nullif(g.k, 0), 0.0) AS r FROM g LEFT JOIN r ON r.k = g.k) SELECT pct::bigint AS pct, k AS passed, round(r, 6) AS bad_rate, round(0.95 * (305 * (1 - r) * pct / 100 - 2000 * pct / 100 * r - 1) - 20 - 1, 3) AS profit FROM j")
def profit_curve(spark, d):
    return curves.pass_grid(lines(spark, d), "l_extendedprice", "y", ["l_orderkey", "l_linenumber"])


# --- encoders --------------------------------------------------------------------------------------------------------


@register("WITH v AS (SELECT o_orderpriority AS value FROM orders UNION SELECT '<unknown>'), c AS (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM v) SELECT code, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE o_orderpriority END AS x FROM orders) o JOIN c ON c.value = CASE WHEN x = 'other' THEN '<unknown>' ELSE x END GROUP BY 1")
def label_encode(spark, d):
    o = table(spark, d, "orders")
    seen = o.select(F.when(F.col("o_orderkey") % 7 == 0, "other").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return encode.label_encode(seen, "o_orderpriority", encode.label_codes(o, "o_orderpriority")).groupBy("code").agg(F.count("*").alias("n"))


@register("SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::int AS l_returnflag_0, (l_returnflag = 'N')::int AS l_returnflag_1 FROM lineitem")
def onehot(spark, d):
    return encode.one_hot(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["A", "N"]).drop("l_returnflag")


@register("WITH c AS (SELECT p_brand, count(*) + 1 AS n FROM part GROUP BY 1) SELECT p_partkey, round(ln(n), 6) AS encoded FROM part JOIN c USING (p_brand)")
def count_encode(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return encode.count_encode(p, "p_brand", p).select("p_partkey", F.round("encoded", 6).alias("encoded"))


@register(f"WITH {L}, g AS (SELECT l_linenumber::bigint AS value, sum(y) AS s, count(*) AS n FROM l GROUP BY 1) SELECT value, n, round((s + 0.1 * n * (sum(s) OVER () / sum(n) OVER ())) / (n * 1.1), 6) AS encoded FROM g")
def target_encode(spark, d):
    return encode.target_means(lines(spark, d).withColumn("l_linenumber", F.col("l_linenumber").cast("long")), "l_linenumber", "y")


@register(f"WITH {L}, {LONG}, {EDGES}, {BINS}, g AS (SELECT bin, sum(y)::double AS p, (count(*) - sum(y))::double AS q FROM binned WHERE feature = 'l_quantity' GROUP BY 1), t AS (SELECT *, sum(p) OVER () AS pa, sum(q) OVER () AS qa FROM g), w AS (SELECT bin, round({WOE}, 6) AS woe FROM t) SELECT woe, count(*) AS n FROM binned JOIN w USING (bin) WHERE feature = 'l_quantity' GROUP BY 1")
def woe_encode(spark, d):
    return encode.woe_encode(lines(spark, d), "l_quantity", "y").groupBy(F.round("woe", 6).alias("woe")).agg(F.count("*").alias("n"))


@register("WITH q AS (SELECT quantile_cont(c_acctbal, 0.05) AS a, quantile_cont(c_acctbal, 0.95) AS b FROM customer) SELECT c_custkey, round((least(greatest(c_acctbal, a), b) - a) / (b - a), 6) AS c_acctbal_scaled FROM customer, q")
def ffm_continuous(spark, d):
    return encode.ffm_continuous(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", "c_acctbal_scaled")


@register("WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 10) SELECT value, row_number() OVER (ORDER BY n DESC, value) + 4 AS idx FROM c UNION ALL SELECT '<unk>', 4")
def ffm_category(spark, d):
    return encode.ffm_vocabulary(table(spark, d, "part"), "p_brand", cutoff=10, offset=4)


@register("SELECT c_custkey, '0:' || (('0x' || md5('c_mktsegment-' || c_mktsegment))::uhugeint % 999999 + 1)::varchar || ':1' AS c_mktsegment_token FROM customer")
def ffm_hash(spark, d):
    return encode.ffm_hashed(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"]).drop("c_mktsegment")


# --- history and splits ----------------------------------------------------------------------------------------------


def _ranked(spark, d):
    return history.ranked_history(loans(spark, d), "o_custkey", "created", "finish", "expected", "o_orderkey")


@register(f"WITH {H}, {HR} SELECT o_custkey, o_orderkey, overdue_days, nth, place FROM r")
def history_rank(spark, d):
    return _ranked(spark, d).select("o_custkey", "o_orderkey", "overdue_days", F.col("nth").cast("double").alias("nth"), "place")


def _spans(column: str, spans: tuple) -> str:
    out = []
    for s in spans:
        x, name = (column, f"{column}_all") if s is None else (f"CASE WHEN place <= {s} THEN {column} END", f"{column}_{s}")
        out += [f"min({x}) AS {name}_min", f"max({x}) AS {name}_max", f"round(avg({x}), 6) AS {name}_mean", f"round(median({x}), 6)::double AS {name}_median", f"round(stddev_pop({x}), 6) AS {name}_std", f"sum({x})::bigint AS {name}_sum", f"count({x}) AS {name}_len", f"max(CASE WHEN place = 1 THEN {column} END) AS {name}_latest", f"round(avg(({x} > 0)::int), 6) AS {name}_share_positive", f"count(*) FILTER ({x} > 0) AS {name}_positive"]
    return ", ".join(out)


@register(f"WITH {H}, {HR} SELECT o_custkey, {_spans('overdue_days', (3, None))} FROM r GROUP BY 1")
def history_features(spark, d):
    return history.span_statistics(_ranked(spark, d), "o_custkey", "place", ["overdue_days"], [3, None])


_CLOCK = ", ".join([f"count(*) FILTER (hour(ts) = {h}) AS hour_{h}" for h in range(24)] + [f"count(*) FILTER (isodow(ts) - 1 = {i}) AS weekday_{i}" for i in range(7)])


@register(f"SELECT user_id, {_CLOCK} FROM events GROUP BY 1")
def time_features(spark, d):
    return history.clock_counts(table(spark, d, "events"), "user_id", "ts")


def _span_sql(keys: str) -> str:
    return f"WITH s AS (SELECT {keys}, datediff('second', lag(ts) OVER w, ts) AS raw, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM events WINDOW w AS (PARTITION BY {keys} ORDER BY ts, event_id)), t AS (SELECT {keys}, us // 1000000 AS d FROM s) SELECT {keys}, min(d) AS least, max(d) AS most, round(avg(d), 6) AS mean, round(median(d), 6)::double AS middle, round(stddev_pop(d), 6) AS std, sum(d)::bigint AS total, count(*) AS len FROM t GROUP BY ALL"


@register(_span_sql("user_id"))
def span_features(spark, d):
    return history.time_spans(table(spark, d, "events"), "user_id", "ts", tie="event_id")


@register(_span_sql("user_id, event_type"))
def span_by_hue(spark, d):
    return history.time_spans(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id")


@register("WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) <= floor(count(*) OVER () * 0.2) AS is_test FROM orders) SELECT o_orderkey, is_test FROM r")
def oot_split(spark, d):
    return split.out_of_time(table(spark, d, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "is_test")


@register("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '-7'), o_orderkey) - 1) % 5 AS fold FROM orders")
def stratified_folds(spark, d):
    return split.stratified_folds(table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "fold")


@register("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '-7'), o_orderkey LIMIT 500")
def hash_sample(spark, d):
    return split.hash_sample(table(spark, d, "orders"), 500, ["o_orderkey"]).select("o_orderkey")


# --- monitoring ------------------------------------------------------------------------------------------------------


@register(f"WITH {EV}, g AS (SELECT event_type, list_sort(list_distinct(list_concat([0.0], quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])))) AS q FROM e WHERE bench GROUP BY 1), b AS (SELECT e.event_type, day, bench, greatest(len(list_filter(q, lambda x: x < value)), 1) AS bin FROM e JOIN g USING (event_type)), x AS (SELECT event_type, unnest(range(1, len(q) + 1)) AS bin FROM g), ex AS (SELECT x.event_type, x.bin, count(b.bin)::double AS n FROM x LEFT JOIN b ON b.bench AND b.event_type = x.event_type AND b.bin = x.bin GROUP BY 1, 2), days AS (SELECT DISTINCT event_type, day FROM b WHERE NOT bench), ac AS (SELECT days.event_type, days.day, ex.bin, ex.n AS en, count(b.bin) + 1e-4 AS an FROM days JOIN ex USING (event_type) LEFT JOIN b ON NOT b.bench AND b.event_type = days.event_type AND b.day = days.day AND b.bin = ex.bin GROUP BY 1, 2, 3, 4), s AS (SELECT *, an / sum(an) OVER w AS a, en / sum(en) OVER w AS e FROM ac WINDOW w AS (PARTITION BY event_type, day)), p AS (SELECT event_type, day, round(sum((a - e) * CASE WHEN e = 0 THEN 10 ELSE greatest(-10, least(10, ln(a / e))) END), 6) AS psi FROM s GROUP BY 1, 2), v AS (SELECT event_type, day, count(*) AS volume, sum(passed)::bigint AS passed FROM e WHERE NOT bench GROUP BY 1, 2) SELECT event_type, day, psi, volume, passed, round(passed / volume, 6) AS pass_ratio FROM p JOIN v USING (event_type, day)")
def psi_by_day(spark, d):
    return monitor.psi_by_time(events(spark, d), "event_type", "value", "bench", "day", "passed")


@register(f"WITH {EV}, b AS (SELECT event_type, value, count(*) AS b FROM e WHERE bench GROUP BY 1, 2), a AS (SELECT event_type, day, value, count(*) AS a FROM e WHERE NOT bench GROUP BY 1, 2, 3), u AS (SELECT DISTINCT a.event_type, a.day, b.value, 0 AS a, b.b FROM a JOIN b USING (event_type) UNION ALL SELECT event_type, day, value, a, 0 FROM a), m AS (SELECT event_type, day, value, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1, 2, 3), r AS (SELECT event_type, day, a, abs(sum(a) OVER w / sum(a) OVER f - sum(b) OVER w / sum(b) OVER f) AS g FROM m WINDOW w AS (PARTITION BY event_type, day ORDER BY value), f AS (PARTITION BY event_type, day)) SELECT event_type, day, round(max(g), 6) AS ks, sum(a)::bigint AS volume FROM r GROUP BY 1, 2")
def feature_ks_by_day(spark, d):
    return monitor.ks_by_time(events(spark, d), "event_type", "value", "bench", "day")


@register(f"WITH {EV} SELECT event_type, day, round(median(value), 6) AS middle, round(stddev_samp(value), 6) AS std, round(avg(value), 6) AS mean FROM e WHERE NOT bench GROUP BY 1, 2")
def feature_stats_by_day(spark, d):
    e, keys = events(spark, d).where("not bench"), ["event_type", "day"]
    middle = ranks.row_quantiles(e, keys, [0.5]).select(*keys, F.round(F.col("q")[0], 6).alias("middle"))
    return e.groupBy(*keys).agg(F.round(F.stddev_samp("value"), 6).alias("std"), F.round(F.avg("value"), 6).alias("mean")).join(middle, keys)


@register("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS double) AS k FROM events")
def json_scores(spark, d):
    return table(spark, d, "events").select("event_id", monitor.json_number("props", "$.k").alias("k"))


# --- mart and sources ------------------------------------------------------------------------------------------------


@register("SELECT n.n_name AS nation, r.r_name AS region, count(*) AS n, sum(o_totalprice::decimal(18, 2))::double AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2")
def mart_base(spark, d):
    t = lambda n: table(spark, d, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return o.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@register("SELECT o_orderkey, count(l_orderkey) AS n_returned FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' AND l_linenumber <= 2 GROUP BY 1")
def mart_label(spark, d):
    li = table(spark, d, "lineitem")
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_returnflag") == "R") & (F.col("l_linenumber") <= 2)
    return table(spark, d, "orders").join(li, on, "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_returned"))


@register("SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, count(*) AS n, round(sum((l_extendedprice * (1 - l_discount))::decimal(18, 4)), 2)::double AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2")
def mart_star(spark, d):
    t = lambda n: table(spark, d, n)
    cn, sn = t("nation").select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("customer_nation")), t("nation").select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("supplier_nation"))
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    x = x.join(cn, F.col("c_nationkey") == F.col("ck"), "left").join(sn, F.col("s_nationkey") == F.col("sk"), "left")
    return x.groupBy("customer_nation", "supplier_nation").agg(F.count("*").alias("n"), F.round(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")), 2).cast("double").alias("revenue"))


@register("SELECT a.o_custkey, a.o_orderkey AS current, b.o_orderkey AS earlier FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate")
def mart_history_selfjoin(spark, d):
    return history.earlier_of_same_key(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


@register("SELECT l_orderkey, l_linenumber, concat_ws(' ', (l_returnflag = 'R')::int::varchar, CASE WHEN l_linenumber <> 0 THEN '1:' || l_linenumber END, CASE WHEN l_quantity <> 0 THEN '2:' || l_quantity::bigint END) AS line FROM lineitem")
def libsvm_rows(spark, d):
    x = lines(spark, d)
    return x.select("l_orderkey", "l_linenumber", files.libsvm_line(F.col("y"), [F.col("l_linenumber"), F.col("l_quantity").cast("long")]).alias("line"))


# --- models ----------------------------------------------------------------------------------------------------------


def _model_frame(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", "y", *NUMERIC)


@register()
def lr_cv(spark, d):
    return models.cross_validate(_model_frame(spark, d), NUMERIC, "y", ["l_orderkey", "l_linenumber"], "lr")


@register()
def gbt_cv(spark, d):
    return models.cross_validate(_model_frame(spark, d), NUMERIC, "y", ["l_orderkey", "l_linenumber"], "gbt", stop_early=True, maxIter=20, maxDepth=5, seed=7)


from ledgerlens.plans import extended, further  # noqa: E402  register the rest

__all__ = ["QUERIES", "SQL", "extended", "further"]
