"""More queries: scalar functions, labels by bin, supervised cuts, profiles, transformers, rules, models, monitoring, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import scalars
from ledgerlens.operators import curves, evaluate, history, labels, mdlp, models, monitor, rules, split, structure, transform
from ledgerlens.plans.base import register
from ledgerlens.plans.frames import NUMERIC, events, lines
from ledgerlens.plans.frames import history as loans
from ledgerlens.session import scratch, table, written
from ledgerlens.sources import files
from ledgerlens.streaming.monitor import drained

L = "l AS (SELECT *, (l_returnflag = 'R')::int AS y, nullif(l_discount, 0.0) AS discount_or_null FROM lineitem)"
LONG = "long AS (SELECT l_linestatus, y, f AS feature, v AS value FROM l, LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice), ('l_discount', l_discount), ('l_tax', l_tax)) t(f, v))"
TENTHS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


def _edges(value: str, source: str, keys: str = "") -> str:
    """Inner decile edges of a column as a list, in SQL."""
    group = f" GROUP BY {keys}" if keys else ""
    q = f"list_sort(list_distinct(quantile_cont({value}, {TENTHS})))"
    return f"SELECT {keys + ', ' if keys else ''}{q}[2:len({q}) - 1] AS e FROM {source}{group}"


# --- scalar functions ------------------------------------------------------------------------------------------------


@register("WITH g AS (SELECT l_returnflag AS flag, min(l_tax) AS a, max(l_tax) AS b, avg((l_linestatus = 'O')::int) AS share, min(l_linenumber) AS c, max(l_linenumber) AS d FROM lineitem GROUP BY 1) SELECT flag, CASE WHEN a = b THEN printf('%.3f', a) ELSE '[ ' || printf('%.3f', a) || ' , ' || printf('%.3f', b) || ' ]' END AS taxes, CASE WHEN c = d THEN c::varchar ELSE '[ ' || c || ' , ' || d || ' ]' END AS numbers, printf('%.2f%%', round(100 * share, 2)) AS open, md5(flag) AS mark, CASE WHEN 100 * share > 110 THEN 3 WHEN 100 * share < 90 THEN 1 ELSE 2 END AS band FROM g")
def scalar_texts(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.min("l_tax").alias("a"), F.max("l_tax").alias("b"), F.avg((F.col("l_linestatus") == "O").cast("int")).alias("share"), F.min("l_linenumber").alias("c"), F.max("l_linenumber").alias("d"))
    return g.select("flag", scalars.range_text(F.col("a"), F.col("b")).alias("taxes"), scalars.range_text(F.col("c"), F.col("d"), None).alias("numbers"), scalars.percent_text(F.round("share", 4)).alias("open"), scalars.md5_text(F.col("flag")).alias("mark"), scalars.index_band(100 * F.col("share")).alias("band"))


@register("WITH x AS (SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::int AS y, 40 * l_tax - 1 AS z FROM lineitem), p AS (SELECT *, 1 / (1 + exp(-greatest(-35, least(35, z)))) AS p FROM x) SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-z)), 6) AS plain, round(p, 6) AS bounded, round(pow(y - p, 2), 6) AS squared, round(abs(exp(y) - exp(p)), 6) AS absolute, round(-(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS logarithmic, round(exp(-y * p), 6) AS exponential, round(y * p + z * 2, 6) AS product FROM p")
def scalar_losses(spark, d):
    x = lines(spark, d).select("l_orderkey", "l_linenumber", F.col("y").cast("double").alias("y"), (40 * F.col("l_tax") - 1).alias("z"))
    y, z = F.col("y"), F.col("z")
    p = scalars.bounded_sigmoid(z)
    r = lambda c, name: F.round(c, 6).alias(name)
    return x.select("l_orderkey", "l_linenumber", r(scalars.sigmoid(z), "plain"), r(p, "bounded"), r(scalars.squared_loss(y, p), "squared"), r(scalars.absolute_loss(y, p), "absolute"), r(scalars.log_loss(y, p), "logarithmic"), r(scalars.exponential_loss(y, p), "exponential"), r(scalars.dot(F.array(y, z), F.array(p, F.lit(2.0))), "product"))


@register("WITH e AS (SELECT event_id, ts, TIMESTAMP '2024-01-01 06:30:00' AS t0 FROM events) SELECT event_id, ((epoch_us(ts) - epoch_us(t0)) // 86400000000)::bigint AS days, (((epoch_us(ts) - epoch_us(t0)) // 1000000) % 86400)::bigint AS seconds, epoch_us(ts) * 1000 AS nanoseconds, datediff('day', t0::date, ts::date)::bigint AS calendar_days FROM e WHERE ts >= t0")
def scalar_times(spark, d):
    t0 = F.lit("2024-01-01 06:30:00").cast("timestamp_ntz")
    e = table(spark, d, "events").where(F.col("ts") >= t0)
    return e.select("event_id", scalars.elapsed_days(t0, F.col("ts")).alias("days"), scalars.seconds_of_day(t0, F.col("ts")).alias("seconds"), scalars.epoch_nanoseconds(F.col("ts")).alias("nanoseconds"), F.datediff("ts", t0).cast("long").alias("calendar_days"))


@register(f"WITH {L}, r AS (SELECT 'big' AS rule, (l_quantity > 40)::int AS c, y FROM l UNION ALL SELECT 'cheap', (l_discount >= 0.05)::int, y FROM l UNION ALL SELECT 'untaxed', (l_tax = 0)::int, y FROM l), a AS (SELECT rule, count(*)::double AS n, sum(c)::double AS h, sum(c * y)::double AS k, sum(y)::double AS p FROM r GROUP BY 1), s AS (SELECT rule, pow(k - p / n * h, 2) / (p / n * h) + pow(h - k - (1 - p / n) * h, 2) / ((1 - p / n) * h) AS chi2 FROM a), z AS (SELECT rule, chi2, list_reduce(list_prepend({{'t': 1.0::double, 's': 1.0::double}}, list_transform(range(1, 121), lambda i: {{'t': i::double, 's': 0.0::double}})), lambda acc, i: {{'t': acc.t * chi2 / (2 * i.t + 1), 's': acc.s + acc.t * chi2 / (2 * i.t + 1)}}) AS e FROM s) SELECT rule, round(chi2, 4) AS chi2, round(CASE WHEN chi2 > 80 THEN 0.0 ELSE greatest(0.0, 1 - sqrt(2 * chi2 / pi()) * exp(-chi2 / 2) * e.s) END, 6) AS p FROM z")
def chi2_p_values(spark, d):
    x = lines(spark, d).select("y", (F.col("l_quantity") > 40).cast("int").alias("big"), (F.col("l_discount") >= 0.05).cast("int").alias("cheap"), (F.col("l_tax") == 0).cast("int").alias("untaxed"))
    return evaluate.chi2_rules(x, ["big", "cheap", "untaxed"], "y", exact=True).select("rule", F.round("chi2", 4).alias("chi2"), F.round("p", 6).alias("p")).orderBy("p")


# --- labels by bin ---------------------------------------------------------------------------------------------------

_RUNNING = f"""
WITH {L}, b AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN y END AS late FROM l),
x AS (SELECT 'y' AS label, f AS feature, v AS value, y FROM b, LATERAL (VALUES ('l_quantity', l_quantity), ('discount_or_null', discount_or_null)) t(f, v)
  UNION ALL SELECT 'late', f, v, late FROM b, LATERAL (VALUES ('l_quantity', l_quantity), ('discount_or_null', discount_or_null)) t(f, v) WHERE late IS NOT NULL),
e AS ({_edges('value', 'x', 'label, feature')}),
g AS (SELECT label, feature, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(e, lambda z: z < value)) END AS bin, min(value) AS a, max(value) AS b, count(*) AS n, sum(y)::double AS p, (count(*) - sum(y))::double AS q FROM x JOIN e USING (label, feature) GROUP BY 1, 2, 3),
t AS (SELECT *, sum(p) OVER w AS pa, sum(q) OVER w AS qa, sum(n) OVER w AS na FROM g WINDOW w AS (PARTITION BY label, feature)),
i AS (SELECT *, CASE WHEN p = 0 OR q = 0 THEN 0.0 ELSE ln((p / pa) / (q / qa)) END AS woe FROM t)
SELECT label, feature, bin::bigint AS bin, CASE WHEN a = b THEN printf('%.3f', a) ELSE '[ ' || printf('%.3f', a) || ' , ' || printf('%.3f', b) || ' ]' END AS range, n, round(n / na, 6) AS share,
  round(woe, 6) AS woe, round((p / pa - q / qa) * woe, 6) AS iv, round(sum((p / pa - q / qa) * woe) OVER (PARTITION BY label, feature ORDER BY bin), 6) AS iv_running FROM i"""


def _late(spark, d):
    return lines(spark, d).withColumn("late", F.when(F.col("l_linestatus") == "O", F.col("y")))


@register(_RUNNING)
def iv_running(spark, d):
    return labels.running_iv(_late(spark, d), ["l_quantity", "discount_or_null"], ["y", "late"])


@register(f"SELECT label, feature, max_by(iv_running, bin) AS iv FROM ({_RUNNING}) GROUP BY 1, 2")
def iv_by_label(spark, d):
    return labels.iv_summary(labels.running_iv(_late(spark, d), ["l_quantity", "discount_or_null"], ["y", "late"]))


@register(f"WITH {L}, b AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN y END AS late FROM l), x AS (SELECT label, f AS feature, v AS value, t FROM b, LATERAL (VALUES ('y', y), ('late', late)) u(label, t), LATERAL (VALUES ('l_quantity', l_quantity), ('l_tax', l_tax)) w(f, v) WHERE t IS NOT NULL AND v IS NOT NULL), c AS (SELECT label, feature, value, sum(t)::double AS p, (count(*) - sum(t))::double AS q FROM x GROUP BY 1, 2, 3), r AS (SELECT *, sum(q) OVER (PARTITION BY label, feature ORDER BY value) AS cq FROM c), a AS (SELECT label, feature, sum(p * (cq - q / 2)) / (sum(p) * sum(q)) AS a FROM r GROUP BY 1, 2) SELECT label, feature, round(greatest(a, 1 - a), 6) AS auc FROM a")
def auc_by_label(spark, d):
    return labels.auc_matrix(_late(spark, d), ["l_quantity", "l_tax"], ["y", "late"])


@register("WITH c AS (SELECT l_quantity AS s, sum((l_returnflag = 'R')::int)::double AS p, sum((l_returnflag <> 'R')::int)::double AS q FROM lineitem GROUP BY 1), r AS (SELECT s, sum(p) OVER w / sum(p) OVER () AS tpr, sum(q) OVER w / sum(q) OVER () AS fpr FROM c WINDOW w AS (ORDER BY s DESC)), g AS (SELECT round(fpr, 6) AS x, max(round(tpr, 6)) AS y FROM r GROUP BY 1) SELECT round(sum(y * (x - coalesce(x0, 0))), 6) AS auc FROM (SELECT x, y, lag(x) OVER (ORDER BY x) AS x0 FROM g)")
def auc_by_steps(spark, d):
    return labels.area_by_steps(curves.threshold_points(lines(spark, d), "l_quantity", "y"))


@register(f"WITH x AS (SELECT f AS feature, v AS value FROM lineitem, LATERAL (VALUES ('l_extendedprice', l_extendedprice), ('l_linenumber', l_linenumber)) t(f, v)), m AS (SELECT feature, min(value) AS a, max(value) AS b FROM x GROUP BY 1), e AS (SELECT feature, list_transform(range(0, 51), lambda i: CASE WHEN feature = 'l_linenumber' THEN ceil(a + i * (b - a) / 50) ELSE a + i * (b - a) / 50 END) AS e FROM m), g AS (SELECT feature, len(list_filter(e[2:50], lambda z: z <= value)) AS bin, any_value(e) AS e, count(*) AS n FROM x JOIN e USING (feature) GROUP BY 1, 2) SELECT feature, bin::bigint AS bin, round(e[bin + 1], 6) AS low, round(e[bin + 2], 6) AS high, n, round(n / sum(n) OVER (PARTITION BY feature), 6) AS share FROM g")
def column_count_bins(spark, d):
    return labels.count_bins(table(spark, d, "lineitem"), ["l_extendedprice", "l_linenumber"], {"l_linenumber"})


_BY_BIN = f"""
WITH {L}, b AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN y END AS late FROM l), e AS ({_edges('l_quantity', '(SELECT * FROM b WHERE late IS NOT NULL)')}),
x AS (SELECT t.label, len(list_filter(e, lambda z: z < l_quantity)) AS bin, l_quantity AS v, t.t AS t FROM b, e, LATERAL (VALUES ('y', y), ('late', late)) t(label, t) WHERE t.t IS NOT NULL),
g AS (SELECT label, bin, min(v) AS a, max(v) AS b, count(*) AS n, sum(t) AS k, avg(t) AS m FROM x GROUP BY 1, 2)
SELECT label, bin::bigint AS bin, CASE WHEN a = b THEN printf('%.3f', a) ELSE '[ ' || printf('%.3f', a) || ' , ' || printf('%.3f', b) || ' ]' END AS range, n, round(n / sum(n) OVER w, 6) AS share,
  k::bigint AS positives, round(k / sum(k) OVER w, 6) AS positive_share, round(m, 6) AS mean FROM g WINDOW w AS (PARTITION BY label)"""


@register(f"SELECT label, bin, range, n, share, mean FROM ({_BY_BIN})")
def labels_mean_by_bin(spark, d):
    return labels.labels_by_bin(_late(spark, d), "l_quantity", ["y", "late"], "late").select("label", "bin", "range", "n", "share", "mean")


@register(f"SELECT label, bin, range, positives, positive_share FROM ({_BY_BIN})")
def labels_dist_by_bin(spark, d):
    return labels.labels_by_bin(_late(spark, d), "l_quantity", ["y", "late"], "late").select("label", "bin", "range", "positives", "positive_share")


@register(f"WITH e AS ({_edges('l_quantity', 'lineitem')}), g AS (SELECT len(list_filter(e, lambda z: z < l_quantity))::bigint AS bin, l_returnflag AS kind, count(*) AS n FROM lineitem, e GROUP BY 1, 2), f AS (SELECT b.bin, k.kind, coalesce(n, 0)::bigint AS n FROM (SELECT DISTINCT bin FROM g) b CROSS JOIN (SELECT DISTINCT kind FROM g) k LEFT JOIN g ON g.bin = b.bin AND g.kind = k.kind), a AS (SELECT *, sum(n) OVER (PARTITION BY bin) AS total FROM f) SELECT bin, kind, n, round(n / total, 6) AS share, round(sum(n) OVER w / sum(total) OVER w, 6) AS running_share FROM a WINDOW w AS (PARTITION BY kind ORDER BY bin)")
def kinds_by_bin(spark, d):
    return labels.kinds_by_bin(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")


@register("WITH g AS (SELECT l_linestatus, l_returnflag, count(*)::double AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY l_linestatus) AS a FROM g) SELECT l_linestatus, max(a)::bigint AS n, count(*) AS classes, round(-sum(n / a * ln(n / a)), 6) AS entropy FROM t GROUP BY 1")
def label_entropy(spark, d):
    return labels.entropy(table(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag")


# --- supervised cuts -------------------------------------------------------------------------------------------------



def _grown(keys: str, levels: int, impurity: str, least: str, accept: str = "true") -> str:
    """SQL of trees over a table counts (keys, value, pos, neg), level by level; the last, ``grown``, has (keys, cuts).

    ``impurity`` is a format of p and q, class counts of a node.
    """
    side = lambda p, q: impurity.format(p=p, q=q)
    fall = f"round({side('p', 'q')} - {side('p1', 'q1')} - {side('(p - p1)', '(q - q1)')}, 9)"
    out = [f"t AS (SELECT {keys}, {least} AS least FROM counts GROUP BY ALL)", f"k0 AS (SELECT DISTINCT {keys}, []::double[] AS cuts FROM counts)"]
    for i in range(1, levels + 1):
        out += [
            f"m{i} AS (SELECT c.*, least, len(list_filter(cuts, lambda z: z < value)) AS node FROM counts c JOIN k{i - 1} USING ({keys}) JOIN t USING ({keys}))",
            f"r{i} AS (SELECT *, sum(pos) OVER w AS p1, sum(neg) OVER w AS q1, sum(pos) OVER f AS p, sum(neg) OVER f AS q, lead(value) OVER w AS nxt FROM m{i} WINDOW w AS (PARTITION BY {keys}, node ORDER BY value), f AS (PARTITION BY {keys}, node))",
            f"b{i} AS (SELECT * FROM (SELECT *, {fall} AS fall FROM r{i} WHERE nxt IS NOT NULL AND p1 + q1 >= least AND p + q - p1 - q1 >= least) QUALIFY row_number() OVER (PARTITION BY {keys}, node ORDER BY fall DESC, value) = 1)",
            f"k{i} AS (SELECT {keys}, list_sort(list_concat(any_value(k.cuts), coalesce(list((value + nxt) / 2) FILTER (fall > 1e-9 AND {accept}), []))) AS cuts FROM k{i - 1} k LEFT JOIN b{i} USING ({keys}) GROUP BY {keys})",
        ]
    return ", ".join(out) + f", grown AS (SELECT * FROM k{levels})"


_GINI = "CASE WHEN {p} + {q} > 0 THEN {p} + {q} - ({p} * {p} + {q} * {q}) / ({p} + {q}) ELSE 0 END"
_XLNX = "(CASE WHEN {0} > 0 THEN {0} * ln({0}) ELSE 0.0 END)"


def _entropy_sql(p: str, q: str) -> str:
    """Entropy times rows."""
    return f"({_XLNX.format(f'({p} + {q})')} - {_XLNX.format(p)} - {_XLNX.format(q)})"


_ENTROPY = _entropy_sql("{p}", "{q}")
_KINDS = "(({0} > 0)::int + ({1} > 0)::int)"
_WORTH = "((fall / (p + q)) >= (ln(p + q - 1) + ln(pow(3, {k}) - 2) - ({k} * {e} - {k1} * {e1} - {k2} * {e2})) / (p + q))".format(
    k=_KINDS.format("p", "q"), k1=_KINDS.format("p1", "q1"), k2=_KINDS.format("(p - p1)", "(q - q1)"),
    e=f"{_entropy_sql('p', 'q')} / (p + q)", e1=f"{_entropy_sql('p1', 'q1')} / (p1 + q1)", e2=f"{_entropy_sql('(p - p1)', '(q - q1)')} / (p + q - p1 - q1)",
)


@register(f"WITH counts AS (SELECT 1 AS z, l_quantity AS value, sum((l_returnflag = 'R')::int)::double AS pos, sum((l_returnflag <> 'R')::int)::double AS neg FROM lineitem GROUP BY 2), {_grown('z', 4, _GINI, 'ceil(0.05 * sum(pos + neg))')} SELECT (i - 1)::bigint AS i, cuts[i] AS cut FROM grown, range(1, 100) r(i) WHERE i <= len(cuts)")
def dt_cut_points(spark, d):
    counts = evaluate.value_counts(lines(spark, d), ["l_quantity"], "y").select("value", "pos", "neg")
    cuts = mdlp.gini_cuts(counts, [], max_depth=4).get((), [])
    return spark.createDataFrame(list(enumerate(cuts)), "i long, cut double")


@register(f"WITH x AS (SELECT f AS feature, v AS value, (l_quantity > 25)::int AS y FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_tax', l_tax), ('l_extendedprice', l_extendedprice)) t(f, v)), counts AS (SELECT feature, value, sum(y)::double AS pos, (count(*) - sum(y))::double AS neg FROM x GROUP BY 1, 2), {_grown('feature', 6, _ENTROPY, '1', _WORTH)} SELECT feature, cut FROM (SELECT feature, unnest(cuts) AS cut FROM grown)")
def mdlp_cut_points(spark, d):
    return mdlp.mdlp_cuts(lines(spark, d).withColumn("big", (F.col("l_quantity") > 25).cast("int")), ["l_quantity", "l_tax", "l_extendedprice"], "big")


@register("WITH x AS (SELECT 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem), e AS (SELECT feature, quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS e FROM x GROUP BY 1) SELECT feature, (1 + len(list_filter(e, lambda z: z <= v)))::bigint AS bin, count(*) AS n FROM x JOIN e USING (feature) GROUP BY 1, 2")
def percentile_five_bins(spark, d):
    return mdlp.fifths(lines(spark, d), ["l_quantity", "l_tax"]).groupBy("feature", "bin").agg(F.sum("n").alias("n"))


_AREA = "greatest(a, 1 - a)"


@register(f"WITH {L}, o AS (SELECT *, (count(*) OVER (PARTITION BY y ORDER BY md5(l_orderkey || '-' || l_linenumber || '-7'), l_orderkey, l_linenumber) - 1) % 5 AS fold FROM l), x AS (SELECT fold, y, f AS feature, v AS value FROM o, LATERAL (VALUES ('l_quantity', l_quantity), ('l_discount', l_discount), ('l_tax', l_tax)) t(f, v)), counts AS (SELECT feature, r.k AS out, value, sum(y)::double AS pos, (count(*) - sum(y))::double AS neg FROM x JOIN range(5) r(k) ON r.k <> fold GROUP BY 1, 2, 3), {_grown('feature, out', 5, _GINI, 'ceil(0.05 * sum(pos + neg))')}, rates AS (SELECT feature, out, len(list_filter(cuts, lambda z: z < value)) AS leaf, sum(pos) / sum(pos + neg) AS rate FROM counts JOIN grown USING (feature, out) GROUP BY ALL), s AS (SELECT x.feature, rate, y FROM x JOIN grown g ON g.feature = x.feature AND g.out = x.fold JOIN rates r ON r.feature = x.feature AND r.out = x.fold AND r.leaf = len(list_filter(g.cuts, lambda z: z < x.value))), scores AS (SELECT 'tree' AS which, feature, rate AS v, sum(y)::double AS p, (count(*) - sum(y))::double AS q FROM s GROUP BY 1, 2, 3 UNION ALL SELECT 'raw', feature, value, sum(y), count(*) - sum(y) FROM x GROUP BY 1, 2, 3), c AS (SELECT *, sum(q) OVER (PARTITION BY which, feature ORDER BY v) AS cq FROM scores), a AS (SELECT which, feature, sum(p * (cq - q / 2)) / (sum(p) * sum(q)) AS a FROM c GROUP BY 1, 2) SELECT feature, max(round({_AREA}, 6)) FILTER (which = 'raw') AS raw, max(round({_AREA}, 6)) FILTER (which = 'tree') AS tree, max(round({_AREA}, 6)) AS auc FROM a GROUP BY 1")
def tree_auc(spark, d):
    return mdlp.tree_auc(lines(spark, d), ["l_quantity", "l_discount", "l_tax"], "y", ["l_orderkey", "l_linenumber"])


# --- evaluation ------------------------------------------------------------------------------------------------------


@register(f"WITH {L}, x AS (SELECT y, coalesce(discount_or_null, -999) AS value FROM l), e AS ({_edges('value', 'x')}), g AS (SELECT len(list_filter(e, lambda z: z < value)) AS bin, sum(y)::double AS p, (count(*) - sum(y))::double AS q FROM x, e GROUP BY 1), t AS (SELECT *, sum(p) OVER () AS pa, sum(q) OVER () AS qa FROM g), i AS (SELECT round(sum((p / pa - q / qa) * CASE WHEN p = 0 THEN -20.0 WHEN q = 0 THEN 20.0 ELSE ln((p / pa) / (q / qa)) END), 6) AS iv FROM t), c AS (SELECT value, sum(y)::double AS p, (count(*) - sum(y))::double AS q FROM x GROUP BY 1), r AS (SELECT *, sum(p) OVER (ORDER BY value) AS cp, sum(q) OVER (ORDER BY value) AS cq, sum(p) OVER () AS pa, sum(q) OVER () AS qa FROM c), k AS (SELECT round(max(abs(cp / pa - cq / qa)), 6) AS ks, sum(p * (cq - q / 2)) / max(pa * qa) AS a FROM r) SELECT 'discount_or_null' AS feature, iv, ks, round(greatest(a, 1 - a), 6) AS auc FROM i, k")
def feature_eval_filled(spark, d):
    return evaluate.evaluate(lines(spark, d).fillna(-999, ["discount_or_null"]), ["discount_or_null"], "y")


@register(f"WITH {L}, e AS ({_edges('l_extendedprice', 'lineitem')}), g AS (SELECT 'l_extendedprice' AS feature, len(list_filter(e, lambda z: z < l_extendedprice))::double AS place, y FROM l, e UNION ALL SELECT 'l_linenumber', l_linenumber, y FROM l) SELECT feature, place, count(*) AS n, round(avg(y), 6) AS rate FROM g GROUP BY 1, 2")
def feature_curves(spark, d):
    return curves.feature_curve(lines(spark, d), ["l_extendedprice", "l_linenumber"], "y")


@register("WITH r AS (SELECT row_number() OVER w AS k, sum((l_returnflag = 'R')::int) OVER w AS bad FROM lineitem WINDOW w AS (ORDER BY l_extendedprice, l_orderkey, l_linenumber)), g AS (SELECT s, floor(100 * s * (SELECT count(*) FROM lineitem) / 100)::bigint AS k FROM (VALUES (0.1), (0.5), (0.9)) t(s)) SELECT s::double AS pass_rate, g.k AS passed, round(bad / g.k, 6) AS bad_rate FROM g JOIN r USING (k)")
def pass_rate_points(spark, d):
    return curves.bad_rate_at(lines(spark, d), "l_extendedprice", "y", ["l_orderkey", "l_linenumber"], [0.1, 0.5, 0.9])


@register("WITH x AS (SELECT l_tax AS s, (l_returnflag = 'R')::int AS y FROM lineitem), n AS (SELECT *, count(*) OVER () AS n FROM x), c AS (SELECT s, sum(y)::double AS p, count(*)::double AS m FROM x GROUP BY 1), r AS (SELECT *, sum(m) OVER (ORDER BY s) AS cm, sum(m) OVER () AS am, sum(p) OVER () AS ap FROM c), t AS (SELECT sum(p * greatest(0, least(m, floor(am / 2) - (cm - m))) / m) > max(ap) / 2 AS turned FROM r), o AS (SELECT CASE WHEN turned THEN -s ELSE s END AS z, s, p, m - p AS q, turned FROM c, t), w AS (SELECT *, sum(p) OVER v AS tp, sum(q) OVER v AS fp, sum(p) OVER () AS pa, sum(q) OVER () AS qa FROM o WINDOW v AS (ORDER BY z DESC)) SELECT s AS score, tp::bigint AS tp, fp::bigint AS fp, round(tp / pa, 6) AS tpr, round(fp / qa, 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (tp + fp + pa), 6) AS f1, round((tp + qa - fp) / (pa + qa), 6) AS accuracy, round(tp / pa - fp / qa, 6) AS distance, turned FROM w")
def oriented_sweep(spark, d):
    return curves.oriented_points(lines(spark, d), "l_tax", "y")


@register("SELECT column_name AS feature, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'TIMESTAMP') THEN 'INT' WHEN data_type = 'DOUBLE' THEN 'FLOAT' ELSE 'STRING' END AS kind, column_name IN ('l_extendedprice', 'l_discount', 'l_tax') AS continuous FROM duckdb_columns() WHERE table_name = 'lineitem'")
def column_kinds(spark, d):
    """Each column's kind, and whether it is a number with values that aren't whole."""
    x = table(spark, d, "lineitem")
    numeric, _ = transform.by_type(x)
    broken = set(mdlp.continuous_columns(x, numeric))
    return spark.createDataFrame([(name, kind, name in broken) for name, kind in structure.kinds_of(x).items()], "feature string, kind string, continuous boolean")


# --- profiles --------------------------------------------------------------------------------------------------------

_PROFILE = """
WITH x AS (SELECT 'all' AS dataset, f AS feature, v FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('discount_or_null', nullif(l_discount, 0.0))) t(f, v)
  UNION ALL SELECT 'open', f, v FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('discount_or_null', nullif(l_discount, 0.0))) t(f, v) WHERE l_linestatus = 'O'),
s AS (SELECT dataset, feature, count(v) AS n, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, count(*) FILTER (v = 0) AS zeros, min(v) AS a, max(v) AS b, list_transform(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda z: round(z, 6)) AS q FROM x GROUP BY 1, 2),
h AS (SELECT dataset, feature, least(9, floor((v - a) / ((b - a) / 10)))::int AS i, count(*) AS k FROM x JOIN s USING (dataset, feature) WHERE v IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT s.dataset, s.feature, list(coalesce(k, 0) ORDER BY r.i)::bigint[] AS hist FROM s CROSS JOIN range(10) r(i) LEFT JOIN h ON h.dataset = s.dataset AND h.feature = s.feature AND h.i = r.i GROUP BY 1, 2)
"""


@register(_PROFILE + "SELECT dataset, feature, 'numeric' AS kind, n AS num_non_missing, missing AS num_missing, 1::bigint AS min_num_values, 1::bigint AS max_num_values, 1.0::double AS avg_num_values, n AS tot_num_values, mean, sd AS std_dev, zeros AS num_zeros, a AS min, q[6] AS median, b AS max, 0::bigint AS num_nan, 0::bigint AS num_posinf, 0::bigint AS num_neginf, round(a, 6) AS low, round(b, 6) AS high, array_to_string(hist, ',') AS histogram, round(list_sum(q), 4) AS quantile_sum FROM s JOIN m USING (dataset, feature)")
def profile_numeric(spark, d):
    x = lines(spark, d)
    both = structure.datasets_profile({"all": x, "open": x.where("l_linestatus = 'O'")}, ["l_quantity", "discount_or_null"])["numeric"]
    return both.withColumn("histogram", F.array_join("histogram", ",")).withColumn("quantile_sum", F.round(F.aggregate("quantiles", F.lit(0.0), lambda a, b: a + b), 4)).drop("quantiles")


@register("WITH x AS (SELECT f AS feature, v FROM orders, LATERAL (VALUES ('o_orderpriority', o_orderpriority), ('o_orderstatus', o_orderstatus)) t(f, v)), c AS (SELECT feature, v, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v DESC) AS k FROM c), s AS (SELECT feature, count(v) AS n, count(*) - count(v) AS missing, round(avg(length(v)), 6) AS len FROM x GROUP BY 1) SELECT feature, 'text' AS kind, s.n AS num_non_missing, missing AS num_missing, 1::bigint AS min_num_values, 1::bigint AS max_num_values, 1.0::double AS avg_num_values, s.n AS tot_num_values, count(*) AS unique, len AS avg_length, max(v) FILTER (k = 1) AS top1, max(v) FILTER (k = 2) AS top2, max(r.n) FILTER (k = 1) AS top1_count FROM s JOIN r USING (feature) GROUP BY feature, s.n, missing, len")
def profile_text(spark, d):
    return structure.text_profile(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


@register("WITH x AS (SELECT embedding AS v FROM embeddings), f AS (SELECT unnest(v)::double AS v FROM x), s AS (SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, count(*) FILTER (v = 0) AS z, min(v) AS a, max(v) AS b FROM f), c AS (SELECT count(*) FILTER (len(v) > 0) AS n, count(*) FILTER (coalesce(len(v), 0) = 0) AS m, min(len(v)) AS lo, max(len(v)) AS hi, round(avg(len(v)), 6) AS av, sum(len(v)) AS t FROM x) SELECT 'embedding' AS feature, n AS num_non_missing, m AS num_missing, lo::bigint AS min_num_values, hi::bigint AS max_num_values, av AS avg_num_values, t::bigint AS tot_num_values, mean, sd AS std_dev, z AS num_zeros, round(a, 6) AS min, round(b, 6) AS max FROM s, c")
def profile_arrays(spark, d):
    return structure.numeric_profile(table(spark, d, "embeddings"), ["embedding"]).select("feature", "num_non_missing", "num_missing", "min_num_values", "max_num_values", "avg_num_values", "tot_num_values", "mean", "std_dev", "num_zeros", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


# --- transformers ----------------------------------------------------------------------------------------------------


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal", F.lit(None).cast("string").alias("empty"), F.lit("x").alias("one"), (F.col("c_acctbal") > 5000).cast("int").alias("rich"))


@register("SELECT c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal, (c_acctbal > 5000)::int AS rich FROM customer")
def preprocess(spark, d):
    return transform.Preprocess(notnull=0.5, notsame=0.05).fit(_customers(spark, d)).transform(_customers(spark, d))


@register("SELECT 'empty' AS feature, count(*) AS null_num, count(*) AS most_value_num FROM customer UNION ALL SELECT 'one', 0, count(*) FROM customer")
def redundant_columns(spark, d):
    kept, report = transform.drop_redundant(_customers(spark, d), 0.1, 0.05)
    return report.where(~F.col("feature").isin(*kept.columns)).select("feature", "null_num", "most_value_num")


@register("WITH v AS (SELECT c_mktsegment AS s FROM customer UNION SELECT '<unknown>'), c AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM v), n AS (SELECT c_nationkey, ln(count(*) + 1) AS m FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) SELECT c_custkey, code::double AS c_mktsegment, round(coalesce(m, 0.0), 6) AS c_nationkey FROM customer JOIN c ON s = c_mktsegment LEFT JOIN n USING (c_nationkey)")
def multi_encode(spark, d):
    c = _customers(spark, d).select("c_custkey", "c_mktsegment", "c_nationkey")
    label = transform.encoder("category", "label").fit(c, ["c_mktsegment"])
    count = transform.encoder("category", "count").fit(c.where("c_custkey % 2 = 0"), ["c_nationkey"])
    return count.transform(label.transform(c)).withColumn("c_nationkey", F.round("c_nationkey", 6))


@register("WITH g AS (SELECT c_mktsegment, sum((c_acctbal > 5000)::int) AS s, count(*) AS n FROM customer GROUP BY 1), m AS (SELECT avg((c_acctbal > 5000)::int) AS m FROM customer) SELECT c_custkey, round((s + 0.1 * n * m) / (n * 1.1), 6) AS c_mktsegment FROM customer JOIN g USING (c_mktsegment), m")
def target_encode_rows(spark, d):
    c = _customers(spark, d).select("c_custkey", "c_mktsegment", "rich")
    return transform.encoder("category", "target", noise=0).fit(c, ["c_mktsegment"], "rich").transform(c).select("c_custkey", F.round("c_mktsegment", 6).alias("c_mktsegment"))


@register("WITH x AS (SELECT c_custkey, c_mktsegment, (c_acctbal > 5000)::int AS y FROM customer), g AS (SELECT c_mktsegment, sum(y)::double AS p, (count(*) - sum(y))::double AS q FROM x GROUP BY 1), t AS (SELECT *, sum(p) OVER () AS pa, sum(q) OVER () AS qa FROM g) SELECT c_custkey, round(CASE WHEN p = 0 THEN -20.0 WHEN q = 0 THEN 20.0 ELSE ln((p / pa) / (q / qa)) END, 6) AS c_mktsegment FROM x JOIN t USING (c_mktsegment)")
def woe_replace(spark, d):
    c = _customers(spark, d).select("c_custkey", "c_mktsegment", "rich")
    return transform.encoder("category", "woe").fit(c, ["c_mktsegment"], "rich").transform(c).select("c_custkey", F.round("c_mktsegment", 6).alias("c_mktsegment"))


_W = "CASE WHEN p = 0 THEN -20.0 WHEN q = 0 THEN 20.0 ELSE ln((p / pa) / (q / qa)) END"


@register(f"WITH {L}, k AS (SELECT *, row_number() OVER () AS id FROM l), x AS (SELECT id, f AS feature, v AS value, y FROM k, LATERAL (VALUES ('l_quantity', l_quantity), ('discount_or_null', discount_or_null)) t(f, v)), e AS ({_edges('value', 'x', 'feature')}), b AS (SELECT x.*, CASE WHEN value IS NOT NULL THEN len(list_filter(e, lambda z: z < value)) END AS bin FROM x JOIN e USING (feature)), g AS (SELECT feature, bin, sum(y)::double AS p, (count(*) - sum(y))::double AS q FROM b WHERE bin IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(p) OVER w AS pa, sum(q) OVER w AS qa FROM g WINDOW w AS (PARTITION BY feature)), w AS (SELECT feature, bin, round({_W}, 6) AS woe FROM t), n AS (SELECT feature, round(ln((count(*) FILTER (value IS NULL AND y = 1) + floor(count(*) * avg(y) * 0.01)) / (count(*) FILTER (value IS NULL AND y = 0) + floor(count(*) * (1 - avg(y)) * 0.01))), 6) AS nul FROM x GROUP BY 1), r AS (SELECT id, max(CASE WHEN b.feature = 'l_quantity' THEN woe END) AS l_quantity, max(CASE WHEN b.feature = 'discount_or_null' THEN coalesce(woe, nul) END) AS discount_or_null FROM b LEFT JOIN w ON w.feature = b.feature AND w.bin = b.bin JOIN n ON n.feature = b.feature GROUP BY 1) SELECT l_quantity, discount_or_null, count(*) AS n FROM r GROUP BY 1, 2")
def woe_encode_columns(spark, d):
    x = lines(spark, d).select("y", "l_quantity", "discount_or_null")
    coded = transform.encoder("continuous", "woe").fit(x, ["l_quantity", "discount_or_null"], "y").transform(x)
    return coded.groupBy("l_quantity", "discount_or_null").agg(F.count("*").alias("n"))


@register(f"WITH e AS ({_edges('c_acctbal', 'customer')}) SELECT c_custkey, len(list_filter(e, lambda z: z < c_acctbal))::bigint AS c_acctbal FROM customer, e")
def binning_encode(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return transform.encoder("continuous", "binning", method="qcut").fit(c, ["c_acctbal"]).transform(c)


@register(f"WITH x AS (SELECT c_custkey, c_mktsegment, c_acctbal, (c_acctbal > 5000)::int AS y FROM customer), n AS (SELECT c_mktsegment, ln(count(*) + 1) AS m FROM x GROUP BY 1), e AS ({_edges('c_acctbal', 'x')}), b AS (SELECT x.*, len(list_filter(e, lambda z: z < c_acctbal)) AS bin FROM x, e), g AS (SELECT bin, sum(y)::double AS p, (count(*) - sum(y))::double AS q FROM b GROUP BY 1), t AS (SELECT *, sum(p) OVER () AS pa, sum(q) OVER () AS qa FROM g) SELECT c_custkey, round(m, 6) AS c_mktsegment, round({_W}, 6) AS c_acctbal FROM b JOIN t USING (bin) JOIN n USING (c_mktsegment)")
def feature_transform(spark, d):
    c = _customers(spark, d)
    made = transform.FeatureTransformer().fit(c, ["c_name", "c_mktsegment", "c_acctbal", "empty", "one"], "rich")
    return made.transform(c).select("c_custkey", F.round("c_mktsegment", 6).alias("c_mktsegment"), F.round("c_acctbal", 6).alias("c_acctbal"))


@register("WITH q AS (SELECT quantile_cont(c_acctbal, 0.05) AS a, quantile_cont(c_acctbal, 0.95) AS b FROM customer), v AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) + 1 AS i FROM customer GROUP BY 1) SELECT c_custkey, (c_acctbal > 5000)::int::varchar || ' 0:0:' || printf('%.6f', (least(greatest(c_acctbal, a), b) - a) / (b - a)) || ' 1:' || i || ':1' AS line FROM customer JOIN v ON s = c_mktsegment, q")
def ffm_rows(spark, d):
    c = _customers(spark, d).select("c_custkey", "c_acctbal", "c_mktsegment", "rich")
    return transform.FieldAwareEncoder().fit(c, ["c_acctbal"], ["c_mktsegment"]).transform(c, "rich").select("c_custkey", "line")


@register("SELECT c_custkey, '0:' || (('0x' || md5(c_nationkey::varchar))::uhugeint % 999999 + 1)::varchar || ':1 1:' || (('0x' || md5('c_mktsegment-' || c_mktsegment))::uhugeint % 999999 + 1)::varchar || ':1' AS line FROM customer")
def ffm_hashed_rows(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", transform.hashed_tokens(c, ["c_nationkey"], ["c_mktsegment"]).alias("line"))


# --- history ---------------------------------------------------------------------------------------------------------

_H = "h AS (SELECT o_orderkey, o_custkey, o_orderdate::date AS created, finish, o_orderdate::date + 30 AS expected FROM orders JOIN (SELECT l_orderkey AS o_orderkey, max(l_shipdate)::date AS finish FROM lineitem GROUP BY 1) USING (o_orderkey))"
_VALID = "a AS (SELECT o_custkey, max(created) AS applied FROM h GROUP BY 1), v AS (SELECT h.* FROM h JOIN a USING (o_custkey) WHERE finish < applied AND finish <> DATE '1000-01-01')"
_PLACED = "p AS (SELECT *, (finish - expected)::bigint AS overdue_days, row_number() OVER (PARTITION BY o_custkey ORDER BY finish DESC, o_orderkey) AS place, (coalesce(lag(created) OVER (PARTITION BY o_custkey ORDER BY created DESC, o_orderkey), max(created) OVER (PARTITION BY o_custkey)) - finish)::bigint AS gap_days FROM v)"


def _valid(spark, d):
    h = loans(spark, d)
    applied = h.groupBy("o_custkey").agg(F.max("created").alias("applied"))
    return history.valid_history(h.join(applied, "o_custkey"), "applied", "finish")


@register(f"WITH {_H}, {_VALID} SELECT o_custkey, o_orderkey, strftime(finish, '%Y-%m-%d') AS finish FROM v")
def history_valid(spark, d):
    return _valid(spark, d).select("o_custkey", "o_orderkey", F.date_format("finish", "yyyy-MM-dd").alias("finish"))


def _smooth_sql() -> str:
    out = []
    for c in ("overdue_days", "gap_days"):
        for span in (3, None):
            x, name = (c, f"{c}_all") if span is None else (f"CASE WHEN place <= {span} THEN {c} END", f"{c}_{span}")
            out += [f"min({x}) AS {name}_min", f"max({x}) AS {name}_max", f"round(avg({x}), 6) AS {name}_mean", f"round(median({x}), 6) AS {name}_median", f"round(stddev_pop({x}), 6) AS {name}_std", f"sum({x}) AS {name}_sum", f"count({x}) AS {name}_len", f"coalesce(max(CASE WHEN place = 1 THEN {c} END), max(CASE WHEN place = 0 THEN {c} END)) AS {name}_latest", f"round(avg(({x} > 0)::int), 6) AS {name}_share_positive", f"count(*) FILTER ({x} > 0) AS {name}_positive"]
    return ", ".join(out)


@register(f"WITH {_H}, {_VALID}, {_PLACED}, m AS (SELECT median(overdue_days)::double AS o, median(gap_days)::double AS g FROM p), u AS (SELECT o_custkey, place, overdue_days::double AS overdue_days, gap_days::double AS gap_days FROM p UNION ALL SELECT DISTINCT c_custkey, 0, o, g FROM customer, m) SELECT o_custkey, {_smooth_sql()} FROM u GROUP BY 1")
def history_smooth(spark, d):
    ranked = history.ranked_history(_valid(spark, d), "o_custkey", "created", "finish", "expected", "o_orderkey")
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return history.HistoryFeatures("o_custkey").fit(ranked).transform(ranked, keys, clocks=False)


@register("WITH s AS (SELECT user_id, event_type, ts, event_id FROM events), d AS (SELECT user_id, event_type, ((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))) // 1000000) / 3600 AS d FROM s), w AS (SELECT user_id, ((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000000) / 3600 AS d FROM s), t AS (SELECT user_id, min(d) AS all_least, round(avg(d), 6) AS all_mean, sum(d) AS all_total, count(*)::double AS all_len FROM w GROUP BY 1), h AS (SELECT user_id, event_type, min(d) AS least, round(avg(d), 6) AS mean, count(*)::double AS len FROM d GROUP BY 1, 2), p AS (SELECT user_id, max(least) FILTER (event_type = 'purchase') AS a, max(mean) FILTER (event_type = 'purchase') AS b, max(len) FILTER (event_type = 'purchase') AS c FROM h GROUP BY 1) SELECT user_id, round(coalesce(all_least, avg(all_least) OVER ()), 4) AS all_least, round(coalesce(all_mean, avg(all_mean) OVER ()), 4) AS all_mean, round(coalesce(all_total, avg(all_total) OVER ()), 4) AS all_total, round(all_len, 4) AS all_len, round(coalesce(a, avg(a) OVER ()), 4) AS purchase_least, round(coalesce(b, avg(b) OVER ()), 4) AS purchase_mean, round(coalesce(c, avg(c) OVER ()), 4) AS purchase_len FROM t LEFT JOIN p USING (user_id)")
def span_margins(spark, d):
    e = table(spark, d, "events")
    out = history.TimeSpanFeatures("user_id", "ts", "event_type", tie="event_id", unit=3600).fit(e).transform(e)
    return out.select("user_id", *(F.round(c, 4).alias(c) for c in ("all_least", "all_mean", "all_total", "all_len", "purchase_least", "purchase_mean", "purchase_len")))


# --- monitoring ------------------------------------------------------------------------------------------------------


@register("SELECT event_id, k AS feature, try_cast(json_extract_string(props, '$.' || k) AS double) AS value FROM events, LATERAL (SELECT unnest(json_keys(props)) AS k) t")
def json_features(spark, d):
    return monitor.parse_features(table(spark, d, "events"), "props", ["event_id"])


_EV = "e AS (SELECT *, ts::date::varchar AS day, ts < TIMESTAMP '2024-01-11' AS bench FROM events), f AS (SELECT event_type, day, bench, k AS feature, try_cast(json_extract_string(props, '$.' || k) AS double) AS value FROM e, LATERAL (SELECT unnest(json_keys(props)) AS k) t)"


@register(f"WITH {_EV}, b AS (SELECT event_type, feature, value, count(*) AS b FROM f WHERE bench AND value IS NOT NULL GROUP BY ALL), a AS (SELECT event_type, feature, day, value, count(*) AS a FROM f WHERE NOT bench AND value IS NOT NULL GROUP BY ALL), u AS (SELECT DISTINCT a.event_type, a.feature, a.day, b.value, 0 AS a, b.b FROM a JOIN b USING (event_type, feature) UNION ALL SELECT event_type, feature, day, value, a, 0 FROM a), m AS (SELECT event_type, feature, day, value, sum(a) AS a, sum(b) AS b FROM u GROUP BY ALL), r AS (SELECT event_type, feature, day, abs(sum(a) OVER w / sum(a) OVER z - sum(b) OVER w / sum(b) OVER z) AS g FROM m WINDOW w AS (PARTITION BY event_type, feature, day ORDER BY value), z AS (PARTITION BY event_type, feature, day)), k AS (SELECT event_type, feature, day, round(round(max(g), 6), 3) AS ks FROM r GROUP BY ALL), t AS (SELECT event_type, feature, day, count(*) AS volume, round(median(value), 6) AS day_median, round(stddev_samp(value), 6) AS day_std, round(avg(value), 6) AS day_mean FROM f WHERE NOT bench GROUP BY ALL), s AS (SELECT event_type, feature, round(median(value), 6) AS bench_median, round(stddev_samp(value), 6) AS bench_std, round(avg(value), 6) AS bench_mean FROM f WHERE bench GROUP BY ALL) SELECT event_type, feature, day, ks, volume, day_median, day_std, day_mean, bench_median, bench_std, bench_mean FROM t LEFT JOIN k USING (event_type, feature, day) LEFT JOIN s USING (event_type, feature)")
def json_feature_stats(spark, d):
    return monitor.monitor(events(spark, d), "event_type", "value", "props", "bench", "day", "passed")["features"]


@register("WITH e AS (SELECT *, ts < TIMESTAMP '2024-01-11' AS bench FROM events), g AS (SELECT event_type, list_sort(list_distinct(list_concat([0.0], quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])))) AS q FROM e WHERE bench GROUP BY 1) SELECT ts::date::varchar AS day, e.event_type, greatest(len(list_filter(q, lambda x: x < value)), 1)::bigint AS bin, count(*) AS n FROM e JOIN g USING (event_type) GROUP BY 1, 2, 3")
def drift_stream(spark, d):
    """Counts by day, type and benchmark bin, by a stream over the events' files."""
    edges = monitor.psi_edges(events(spark, d).where("bench"), "event_type", "value")
    # A pattern, since a stream takes a path without one for a folder.
    return drained(spark, f"{d}/[e]vents.parquet", edges, "event_type", "value", "ts").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", F.col("bin").cast("long").alias("bin"), "n")


# --- rows of sets, predicates, tables ---------------------------------------------------------------------------------


@register("SELECT o_orderkey FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') r USING (o_orderkey)")
def orders_without_returns(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_anti")


@register("SELECT o_orderkey FROM orders SEMI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') r USING (o_orderkey)")
def orders_with_returns(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_semi")


@register("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def nations_left_over(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").select("s_nationkey"))


@register("SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier")
def people(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)


@register("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'dear' ELSE 'cheap' END AS price, datediff('day', o_orderdate::date, DATE '1998-12-31')::bigint AS age, instr(o_orderpriority, '-')::bigint AS dash FROM orders WHERE o_orderstatus IN ('F', 'O') AND (o_totalprice BETWEEN 1000 AND 50000 OR o_totalprice BETWEEN 100000 AND 200000)")
def predicate_sql(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("ledger_orders")
    return spark.sql("SELECT o_orderkey, IF(o_totalprice > 100000, 'dear', 'cheap') AS price, CAST(datediff(DATE'1998-12-31', o_orderdate) AS bigint) AS age, CAST(instr(o_orderpriority, '-') AS bigint) AS dash FROM ledger_orders WHERE o_orderstatus IN ('F', 'O') AND (o_totalprice BETWEEN 1000 AND 50000 OR o_totalprice BETWEEN 100000 AND 200000)")


@register("SELECT count(*) AS n, sum((l_returnflag = 'R')::int)::bigint AS events FROM lineitem WHERE NOT (l_quantity >= 30 AND l_discount <= 0.05)")
def cases_left(spark, d):
    return rules.remove_cases(lines(spark, d), [[("l_quantity", ">=", 30), ("l_discount", "<=", 0.05)]]).agg(F.count("*").alias("n"), F.sum("y").alias("events"))


@register("WITH x AS (SELECT (l_returnflag = 'R')::int::double AS label, l_quantity AS a, l_linenumber AS b FROM lineitem) SELECT label, count(*) AS n, round(sum(a / (a * a + b * b)), 6) AS first_sum, round(sum(b / (a * a + b * b)), 6) AS second_sum FROM x GROUP BY 1")
def libsvm_read(spark, d):
    path = scratch(spark, "libsvm")
    x = lines(spark, d).select(files.libsvm_line(F.col("y"), [F.col("l_quantity"), F.col("l_linenumber")]).alias("line"))
    files.write_lines(x, "line", path)
    back = files.read_libsvm(spark, path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("values")[0]), 6).alias("first_sum"), F.round(F.sum(F.col("values")[1]), 6).alias("second_sum"))


@register("SELECT c_custkey, c_name, c_acctbal FROM customer")
def delimited_round_trip(spark, d):
    c, path = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), scratch(spark, "delimited")
    files.write_delimited(c, path)
    return files.cached_copy(spark, path, c.schema, f"{path}-copy")


# --- splits and models -----------------------------------------------------------------------------------------------


@register("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '-7'), o_orderkey) <= ceil(count(*) OVER () * 0.2) AS is_test FROM orders) SELECT o_orderkey, is_test FROM r")
def random_split(spark, d):
    return split.random_split(table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


@register("WITH x AS (SELECT o_orderkey, o_orderstatus AS s, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders), t AS (SELECT s, n FROM x GROUP BY 1, 2), m AS (SELECT s FROM t ORDER BY n DESC, s LIMIT 1), k AS (SELECT greatest(1, round_even((SELECT n FROM t WHERE s = (SELECT s FROM m)) / (SELECT avg(n) FROM t WHERE s <> (SELECT s FROM m)) / 0.5, 0))::bigint AS k) SELECT o_orderkey, CASE WHEN s = (SELECT s FROM m) THEN (row_number() OVER (PARTITION BY s ORDER BY md5(o_orderkey || '-7'), o_orderkey) - 1) % (SELECT k FROM k) ELSE -1 END AS chunk FROM x")
def imbalance_chunks(spark, d):
    return models.imbalance_chunks(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 0.5)[0].select("o_orderkey", F.coalesce("chunk", F.lit(-1)).cast("long").alias("chunk"))


def _frame(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", *NUMERIC, (F.col("l_extendedprice") * F.col("l_quantity") > 1_000_000).cast("int").alias("big"))


_IDS = ["l_orderkey", "l_linenumber"]


@register()
def train_service(spark, d):
    """Split, encoded, cross-validated and refitted by one configuration; figures of the refit and of the folds."""
    service = models.TrainService({"label": "big", "ident": _IDS, "features": ["l_quantity", "l_discount", "l_tax"], "transform": {"few": 5}, "model": {"kind": "lr"}, "folds": 5})
    made = service.fit(_frame(spark, d))
    return made["figures"].union(made["summary"].where("metric = 'auc'").select(F.concat(F.lit("mean of "), "part"), "mean", "std"))


@register()
def model_cost(spark, d):
    """The same model on subsets of columns, by training and test rows."""
    marked = written(split.random_split(_frame(spark, d), _IDS).drop(*_IDS), "marked")
    return models.compare_columns(marked.where("not is_test"), marked.where("is_test"), "big", {"quantity": ["l_quantity"], "both": ["l_quantity", "l_extendedprice"], "taxes": ["l_tax", "l_discount"]})


@register()
def imbalance_cv(spark, d):
    """Averaged out-of-fold scores of models on chunks of the commoner class, by decile of the score."""
    x = _frame(spark, d)
    found = models.imbalance_scores(x, ["l_quantity", "l_extendedprice"], "big", _IDS, folds=3)
    return models.figures(found, "big", rows="all")


@register()
def fm_fit(spark, d):
    """A factorisation machine on two factors of a product, by training and test rows."""
    marked = written(split.random_split(_frame(spark, d), _IDS).drop(*_IDS), "marked")
    model = models.fitted(marked.where("not is_test"), ["l_quantity", "l_extendedprice", "l_tax"], "big", "fm", factorSize=4, stepSize=0.05, seed=7)
    return models.figures(models.scored(model, marked.where("is_test")), "big", part="test")
