"""URL filter by rules and by templates of each host's paths.

Where no rule fits, the path's template decides. Path segments form a tree for
each host. Digits and long hexadecimal runs are wildcards from the start. Then,
level by level, rare segments of a parent with many kinds of them become one
wildcard, and branches whose continuations and labels don't differ from their
siblings' as a whole are merged. A template is rejected if its pages are bad
often enough: labels are those of the rules, and good ones are assumed for as
many pages as have none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import looked_up, measured, table, written
from ledgerlens.llm.decontaminate import LOWER, UPPER

#: A path's segments from this one on are one segment.
DEPTH = 6
#: A parent of more kinds of segments than this keeps those that have one in so many of its pages.
WIDE = 20
#: Branches are similar below the 99.9 % point of chi-square or at so little a difference, and if rates of bad labels differ by so much at most.
POINT, LITTLE, RATES = 3.09, 0.05, 0.2
#: Weight and rate of the prior of a template, and the purity from which it is rejected.
PRIOR, CLEAN, IMPURE = 10, 0.1, 0.5
#: Rules become one expression.
MOST_RULES = 500

_HEX = "[0-9a-fA-F]"
#: What is variable in a segment by its form, and its wildcard.
_FORMS = [(f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}|{_HEX}{{16,}}", "{h}"), ("[0-9]+", "{n}")]
#: A continuation is told by its segments: 0 with a wildcard, a without.
_COARSE = [("[^/]*[{][^/]*", "0"), ("[^/0]+", "a")]


@dataclass(frozen=True)
class Rule:
    """Allows or blocks the paths that begin with ``path`` of a host and its subdomains."""

    allow: bool
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between :// and the path, A-Z in lower case, and the path up to a query or fragment; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _rule(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and whether it allows; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{MOST_RULES} rules at most")
    name, allows = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        name, allows = F.when(fits, r.name).otherwise(name), F.when(fits, r.allow).otherwise(allows)
    return name, allows


def _segments(path: Column) -> Column:
    """The path's segments with wildcards for what is variable by its form."""
    for pattern, wildcard in _FORMS:
        path = F.regexp_replace(path, pattern, wildcard)
    parts = F.split(path, "/", -1)
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(parts) <= DEPTH, parts).otherwise(F.concat(F.slice(parts, 1, DEPTH - 1), F.array(F.array_join(F.slice(parts, DEPTH, F.size(parts)), "/"))))


def _level(paths: DataFrame, total: int, depth: int) -> DataFrame:
    """The paths (host, parts, n, bad, good, done) with ``done`` one segment longer, where they have one more."""
    going = paths.where(F.size("parts") >= depth).withColumn("seg", F.element_at("parts", depth))
    parent = ["host", "done"]
    kinds = going.groupBy(*parent, "seg").agg(F.sum("n").alias("seg_n"), F.count("*").alias("rows"))
    kinds = written(kinds, "url-segments")
    parents = kinds.groupBy(*parent).agg(F.sum("seg_n").alias("all"), F.count("*").alias("kinds"))
    kept = looked_up(kinds, parents, parent, "kinds", total).where((F.col("kinds") <= WIDE) | (F.col("seg_n") * WIDE >= F.col("all")))
    kept = kept.select(*parent, "seg", F.col("seg").alias("kept"), "rows")
    going = written(looked_up(going, kept, [*parent, "seg"], "rows", total, "left").withColumn("branch", F.coalesce("kept", F.lit("*"))).drop("seg", "kept", "rows"), "url-branches")

    rest = F.when(F.size("parts") > depth, F.concat(F.lit("/"), F.array_join(F.slice("parts", depth + 1, DEPTH), "/"))).otherwise("")
    for pattern, sign in _COARSE:
        rest = F.regexp_replace(rest, pattern, sign)
    cells = going.groupBy(*parent, "branch", rest.alias("rest")).agg(*(F.sum(c).alias(c) for c in ("n", "bad", "good")), F.count("*").alias("rows"))
    # A parent has at most WIDE + 1 branches, and few forms of what follows.
    of_rest, of_parent, of_branch = (Window.partitionBy(*parent, *k) for k in (["rest"], [], ["branch"]))
    shapes = F.size(F.collect_set("rest").over(of_parent))
    cells = cells.select("*", F.sum("n").over(of_rest).alias("rest_n"), *(F.sum(c).over(of_parent).alias(f"all_{c}") for c in ("n", "bad", "good")), shapes.alias("shapes"))
    branches = cells.groupBy(*parent, "branch").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "good", "rows")), F.sum(F.col("n") * F.col("n") / F.col("rest_n")).alias("fit"), *(F.first(c).alias(c) for c in ("all_n", "all_bad", "all_good", "shapes")))
    chi2 = F.col("fit") * F.col("all_n") / F.col("n") - F.col("n")
    free = F.greatest(F.col("shapes") - 1, F.lit(1))
    point = free * F.pow(1 - 2 / (9 * free) + POINT * F.sqrt(2 / (9 * free)), F.lit(3))
    rate = lambda p: F.try_divide(F.col(f"{p}bad"), F.col(f"{p}bad") + F.col(f"{p}good"))
    alike = (chi2 <= F.greatest(point, LITTLE * F.col("n"))) & F.coalesce(F.abs(rate("") - rate("all_")) <= RATES, F.lit(True))
    merged = branches.select(*parent, "branch", "rows", alike.alias("alike")).withColumn("many", F.count_if("alike").over(Window.partitionBy(*parent)))
    merged = merged.select(*parent, "branch", "rows", F.when(F.col("alike") & (F.col("many") > 1), "~").otherwise(F.col("branch")).alias("token"))
    longer = looked_up(going, merged, [*parent, "branch"], "rows", total).withColumn("done", F.concat("done", F.lit("/"), "token"))
    return longer.select(paths.columns).unionByName(paths.where(F.size("parts") < depth))


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page by its url.

    ``rule`` is the longest that fits, and then decides; else null. ``template``
    is the path's in its host's tree, ``purity`` the smoothed share of bad
    labels of its pages, of which those of ``allow`` rules are good and those
    of ``block`` rules bad; where no rule fits, the verdict is ``block`` from
    IMPURE on. A prior rate of CLEAN weighs as much as the pages without
    label, PRIOR at least, so a template without labels is allowed.

    A url that is null or has no :// has an empty host and path, and no rule
    fits it. Repeated rows and ids each keep a row; null ids stay null; other
    columns are left out; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, allows = _rule(rules)
    rows = rows.select("*", name.alias("rule"), allows.alias("allows"), _segments(F.col("path")).alias("parts"))
    rows = rows.withColumn("whole", F.to_json("parts"))
    figures = (F.count("*").alias("n"), F.count_if(~F.col("allows")).alias("bad"), F.count_if("allows").alias("good"))
    paths, seen = measured(rows.groupBy("host", "whole").agg(F.first("parts").alias("parts"), *figures).withColumn("done", F.lit("")), "url-paths", rows=F.count("*"), pages=F.coalesce(F.sum("n"), F.lit(0)), deep=F.coalesce(F.max(F.size("parts")), F.lit(0)))
    for depth in range(1, seen["deep"] + 1):
        paths = written(_level(paths, seen["rows"], depth), "url-paths")
    templates = paths.groupBy("host", "done").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "good")), F.count("*").alias("rows"))
    labelled = F.col("bad") + F.col("good")
    weight = F.greatest(F.lit(PRIOR), F.col("n") - labelled)
    templates = templates.select("host", "done", "rows", ((F.col("bad") + CLEAN * weight) / (labelled + weight)).alias("purity"))
    judged = written(looked_up(paths.select("host", "done", "whole", "n"), templates, ["host", "done"], "rows", seen["rows"]), "url-templates")
    out = looked_up(written(rows.drop("parts"), "url-rows"), judged.select("host", "whole", F.col("done").alias("template"), "purity", "n"), ["host", "whole"], "n", seen["pages"])
    verdict = F.when(F.coalesce("allows", F.col("purity") < IMPURE), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


RULES = [Rule(True, "com"), Rule(False, "example.com", "/en/"), Rule(True, "www.example.com", "/en/"), Rule(False, "net", "/es/"), Rule(False, "net", "/fr/")]


def op11_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def _sql() -> str:
    """DuckDB, level by level with windows."""
    forms = "path"
    for pattern, wildcard in _FORMS:
        forms = f"regexp_replace({forms}, '{pattern}', '{wildcard}', 'g')"
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN {value(r)}" for r in ordered) + " END"
    ctes = [
        "u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages)",
        r"h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"r AS (SELECT *, {case(lambda r: repr(r.name))} AS rule, {case(lambda r: str(r.allow).lower())} AS allows, string_split({forms}, '/')[2:] AS s FROM h)",
        f"l0 AS (SELECT *, CASE WHEN len(s) <= {DEPTH} THEN s ELSE list_append(s[:{DEPTH - 1}], array_to_string(s[{DEPTH}:], '/')) END AS parts, '' AS done FROM r)",
    ]
    for d in range(1, DEPTH + 1):
        rest = f"CASE WHEN len(parts) > {d} THEN '/' || array_to_string(parts[{d + 1}:], '/') ELSE '' END"
        for pattern, sign in _COARSE:
            rest = f"regexp_replace({rest}, '{pattern}', '{sign}', 'g')"
        ctes += [
            f"g{d} AS (SELECT *, parts[{d}] AS seg, {rest} AS rest FROM l{d - 1} WHERE len(parts) >= {d})",
            f"k{d} AS (SELECT *, sum(sn) OVER p AS al, count(*) OVER p AS kinds FROM (SELECT host, done, seg, count(*) AS sn FROM g{d} GROUP BY ALL) WINDOW p AS (PARTITION BY host, done))",
            f"b{d} AS (SELECT g.*, CASE WHEN kinds <= {WIDE} OR sn * {WIDE} >= al THEN seg ELSE '*' END AS branch FROM g{d} g JOIN k{d} USING (host, done, seg))",
            f"c{d} AS (SELECT host, done, branch, rest, count(*) AS n, count(*) FILTER (NOT allows) AS bad, count(*) FILTER (allows) AS good FROM b{d} GROUP BY ALL)",
            f"w{d} AS (SELECT *, sum(n) OVER (PARTITION BY host, done, rest) AS rn, sum(n) OVER p AS an, sum(bad) OVER p AS ab, sum(good) OVER p AS ag, greatest(len(list_distinct(list(rest) OVER p)) - 1, 1)::double AS free FROM c{d} WINDOW p AS (PARTITION BY host, done))",
            f"a{d} AS (SELECT host, done, branch, sum(n)::double AS n, sum(bad) AS bad, sum(good) AS good, sum(n * n / rn) AS fit, any_value(an) AS an, any_value(ab) AS ab, any_value(ag) AS ag, any_value(free) AS free FROM w{d} GROUP BY ALL)",
            f"m{d} AS (SELECT host, done, branch, fit * an / n - n <= greatest(free * pow(1 - 2 / (9 * free) + {POINT} * sqrt(2 / (9 * free)), 3), {LITTLE} * n) AND coalesce(abs(bad / nullif(bad + good, 0) - ab / nullif(ab + ag, 0)) <= {RATES}, true) AS alike FROM a{d})",
            f"t{d} AS (SELECT host, done, branch, CASE WHEN alike AND count(*) FILTER (alike) OVER (PARTITION BY host, done) > 1 THEN '~' ELSE branch END AS token FROM m{d})",
            f"l{d} AS (SELECT page_id, host, path, rule, allows, parts, b.done || '/' || token AS done FROM b{d} b JOIN t{d} USING (host, done, branch) UNION ALL SELECT page_id, host, path, rule, allows, parts, done FROM l{d - 1} WHERE len(parts) < {d})",
        ]
    ctes += [
        f"f AS (SELECT *, count(*) FILTER (NOT allows) OVER p AS bad, count(*) FILTER (allows IS NOT NULL) OVER p AS known, greatest({PRIOR}, count(*) FILTER (allows IS NULL) OVER p) AS weight FROM l{DEPTH} WINDOW p AS (PARTITION BY host, done))",
        f"q AS (SELECT *, (bad + {CLEAN}::double * weight) / (known + weight) AS purity FROM f)",
    ]
    return f"WITH {', '.join(ctes)} SELECT page_id, host, path, rule, CASE WHEN coalesce(allows, purity < {IMPURE}) THEN 'allow' ELSE 'block' END AS verdict, done AS template, round(purity, 6) AS purity FROM q"


OP11_SQL = _sql()
