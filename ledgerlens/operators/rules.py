"""Rule sets: OR of rules, each an AND of (column, operator, value); learned by growing, pruning and description length."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerlens.operators.profile import long_form
from ledgerlens.operators.ranks import quantiles, value_table

Condition = tuple[str, str, object]
Rule = list[Condition]


@dataclass(frozen=True)
class Level:
    """A value of an ordered category: ``order`` lists all of them, the least first. Others, and nulls, are neither at least nor at most it."""

    value: str
    order: tuple[str, ...]


_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: ~a.eqNullSafe(b), ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def _holds(column: str, op: str, value: object) -> Column:
    if not isinstance(value, Level):
        return _COMPARE[op](F.col(column), F.lit(value))
    at = value.order.index(value.value)
    return F.col(column).isin(*{">=": value.order[at:], "<=": value.order[: at + 1], "==": [value.value]}[op])


def covers(rules: list[Rule]) -> Column:
    """Whether any rule holds; no rules hold nothing, comparisons with null fail but != holds."""
    one = lambda rule: reduce(and_, (F.coalesce(_holds(*condition), F.lit(False)) for condition in rule), F.lit(True))
    return reduce(or_, (one(r) for r in rules), F.lit(False))


def remove_cases(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that no rule covers."""
    return df.where(~covers(rules))


def conditions(df: DataFrame, columns: list[str], q: int = 10, most: int = 100, ordered: dict[str, list[str]] | None = None) -> dict[str, list[Condition]]:
    """Conditions by column.

    Equal to a value of two; equal or unequal to a text (of ``most``
    commonest); at least or at most one of q + 1 quantiles, the ends among
    them; at least or at most a value that occurs of an ``ordered`` category,
    whose values are given from the least to the greatest.
    """
    ordered = ordered or {}
    counts = long_form(df, columns, "string").where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    kinds = {r["feature"]: r["k"] for r in counts.groupBy("feature").agg(F.count("*").alias("k")).collect()}
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    found: dict[str, list[Condition]] = {}
    for c in columns:
        number = c in numeric
        if number and kinds.get(c, 0) > 2:
            continue
        if c in ordered and kinds.get(c, 0) > 2:
            order = tuple(ordered[c])
            there = {r["value"] for r in counts.where((F.col("feature") == c) & F.col("value").isin(*order)).select("value").collect()}
            found[c] = [(c, op, Level(v, order)) for v in order if v in there for op in (">=", "<=")]
            continue
        values = [r["value"] for r in counts.where(F.col("feature") == c).orderBy(F.desc("n"), "value").limit(most).select("value").collect()]
        values = [float(v) for v in values] if number else values
        found[c] = [(c, op, v) for v in values for op in (("==",) if kinds.get(c, 0) <= 2 else ("==", "!="))]
    many = [c for c in columns if c not in found]
    if many:
        edges = quantiles(value_table(long_form(df, many, "double"), ["feature"]), ["feature"], [i / q for i in range(q + 1)])
        for r in edges.select("feature", F.array_distinct("q").alias("q")).collect():
            found[r["feature"]] = [(r["feature"], op, e) for e in r["q"] for op in (">=", "<=")]
    return found


def condition_rows(spark: SparkSession, found: dict[str, list[Condition]]) -> DataFrame:
    """(feature, op, text, number): the conditions as a table, with a text or a number each."""
    plain = lambda v: v.value if isinstance(v, Level) else v
    rows = [(c, op, plain(v)) for each in found.values() for c, op, v in each]
    return spark.createDataFrame([(c, op, v if isinstance(v, str) else None, None if isinstance(v, str) else float(v)) for c, op, v in rows], "feature string, op string, text string, number double")


def _tally(df: DataFrame, positive: Column, tests: list[Column]) -> tuple[int, int, list[tuple[int, int]]]:
    """Positives and negatives of the frame and of each test's rows, in one job."""
    sums = [e for i, t in enumerate(tests) for e in (F.count_if(t & positive).alias(f"p{i}"), F.count_if(t & ~positive).alias(f"n{i}"))]
    row = df.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"), *sums).first()
    return row["p"], row["n"], [(row[f"p{i}"], row[f"n{i}"]) for i in range(len(tests))]


def foil_gain(p0: int, n0: int, p1: int, n1: int, least: int) -> float:
    """log10 of the positives that stay by the rise of their share; a rule of fewer than ``least`` positives is refused."""
    if p1 < least or not p1 or not p0 + n0:
        return -10000.0
    return math.log10(p1) * (p1 / (p1 + n1) - p0 / (p0 + n0))


def grow_rule(df: DataFrame, positive: Column, candidates: dict[str, list[Condition]], least: int = 100, rule: Rule | None = None) -> Rule:
    """Adds the condition of the best gain on an unused column, one job for all of them a step, until none gains."""
    rule = list(rule or [])
    while True:
        open_ = [c for name, cs in candidates.items() if name not in {r[0] for r in rule} for c in cs]
        base = covers([rule])
        p, n, each = _tally(df, positive, [base, *(base & covers([[c]]) for c in open_)])
        (p0, n0), each = each[0], each[1:]
        if not open_ or not p0 or not n0:
            return rule
        best, at = max((foil_gain(p0, n0, p1, n1, least), -i) for i, (p1, n1) in enumerate(each))
        if best <= 0:
            return rule
        rule.append(open_[-at])


def prune_rule(df: DataFrame, positive: Column, rule: Rule) -> Rule:
    """The prefix with the greatest (p-n)/(p+n); a rule that covers nothing stays."""
    cuts = [rule[:k] for k in range(len(rule), 0, -1)]
    if not cuts:
        return rule
    _, _, each = _tally(df, positive, [covers([r]) for r in cuts])
    worth = [((p - n) / (p + n), -i) for i, (p, n) in enumerate(each) if p + n]
    return cuts[-max(worth)[1]] if worth else rule


def rule_length(size: int, possible: int) -> int:
    """Half the bits of choosing ``size`` of ``possible`` conditions, whole."""
    if not size or size >= possible:
        return 0 if not size else int(0.5 * math.log2(max(1, size)))
    p = size / possible
    return int(0.5 * (math.log2(size) + size * math.log2(1 / p) + (possible - size) * math.log2(1 / (1 - p))))


def _choose_bits(n: int, k: int) -> float:
    return (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(2) if n else 0.0


def set_length(rules: list[Rule], possible: int, p: int, n: int, covered_p: int, covered_n: int) -> float:
    """Bits of a rule set and of naming the rows that it gets wrong."""
    theory = sum(rule_length(len(r), possible) for r in rules)
    return theory + _choose_bits(covered_p + covered_n, covered_n) + _choose_bits(p + n - covered_p - covered_n, p - covered_p)


@dataclass
class Ripper:
    """Decision list by repeated incremental pruning, rarest class first; the commonest class is what no rule covers.

    Rows are split for growing and pruning by a hash of ``ident``. A class's
    rules end when no rule grows, no positives are left, or the next rule's
    length is above the least one so far by ``dl_threshold``; there is no
    other bound on their number. Each is then held ``k`` times against a
    replacement and a revision, by the description length of the whole set.
    ``ordered`` gives the values of ordered categories from the least on.
    """

    prune_ratio: float = 0.2
    dl_threshold: int = 64
    k: int = 2
    least: int = 100
    q: int = 10
    ordered: dict[str, list[str]] = field(default_factory=dict)
    rules: list[tuple[object, list[Rule]]] = field(default_factory=list)
    default: object = None

    def _learn(self, df: DataFrame, positive: Column, candidates: dict[str, list[Condition]]) -> list[Rule]:
        possible, rest, rules, least = sum(map(len, candidates.values())), df, [], None
        while True:
            rule = self._made(rest, positive, candidates)
            if not rule:
                return rules
            length = rule_length(len(rule), possible)
            if least is not None and least + self.dl_threshold < length:
                return rules
            p, _, ((p1, _),) = _tally(rest, positive, [covers([rule])])
            if not p1:
                return rules
            least = length if least is None else min(least, length)
            rules.append(rule)
            rest = rest.where(~covers([rule]))
            if p1 == p:
                return rules

    def _made(self, df: DataFrame, positive: Column, candidates: dict[str, list[Condition]], start: Rule | None = None) -> Rule:
        grown = grow_rule(df.where("not _prune"), positive, candidates, self.least, start)
        return prune_rule(df.where("_prune"), positive, grown) if grown else []

    def _optimise(self, df: DataFrame, positive: Column, candidates: dict[str, list[Condition]], rules: list[Rule]) -> list[Rule]:
        possible, kept = sum(map(len, candidates.values())), list(rules)
        for rule in rules:
            rest = [r for r in kept if r != rule]
            others = df.where(~covers(rest))
            variants = [rule, self._made(others, positive, candidates), self._made(others, positive, candidates, rule)]
            sets = [rest + ([v] if v else []) for v in variants]
            p, n, each = _tally(df, positive, [covers(s) for s in sets])
            best = min(range(3), key=lambda j: (set_length(sets[j], possible, p, n, *each[j]), j))
            kept = sets[best]
        return kept

    def fit(self, df: DataFrame, label: str, columns: list[str], ident: list[str]) -> Ripper:
        rows = df.where(F.col(label).isNotNull()).select(label, *columns, (F.pmod(F.xxhash64(*ident), F.lit(1000)) < int(1000 * self.prune_ratio)).alias("_prune"))
        # Gone over once for each condition of a rule: kept where it fits, on disk elsewhere.
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counts = rows.groupBy(label).count().orderBy("count", label).collect()
            self.default, self.rules = (counts[-1][0] if counts else None), []
            candidates, rest = conditions(rows, columns, self.q, ordered=self.ordered), rows
            for value, _ in counts[:-1]:
                positive = F.col(label) == F.lit(value)
                rules = self._learn(rest, positive, candidates)
                for _ in range(self.k):
                    rules = self._optimise(rest, positive, candidates, rules)
                self.rules.append((value, rules))
                rest = rest.where(~covers(rules))
        finally:
            rows.unpersist()
        return self

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Adds the class of the first class whose rules cover the row, else the commonest."""
        return df.withColumn(out, F.coalesce(*(F.when(covers(rules), F.lit(value)) for value, rules in self.rules), F.lit(self.default)))
