"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of evidence of bins without one of the classes (fixed values).
WOE_LIMIT = 20.0


def woe(pos: Column, neg: Column, pos_all: Column, neg_all: Column) -> Column:
    """ln of the share of events over the share of non-events, -20 and 20 where one is missing."""
    return F.when(pos == 0, -WOE_LIMIT).when(neg == 0, WOE_LIMIT).otherwise(F.ln((pos / pos_all) / (neg / neg_all)))


def iv_part(pos: Column, neg: Column, pos_all: Column, neg_all: Column) -> Column:
    return (pos / pos_all - neg / neg_all) * woe(pos, neg, pos_all, neg_all)


def bin_of(x: Column, edges: Column) -> Column:
    """Number of inner edges below x: right-closed bins from 0; null for null."""
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e < x)).cast("long"))


def bin_of_few(x: str, edges: str, most: int) -> Column:
    """:func:`bin_of` for at most ``most`` edges: compiled, where an array function calls one for each element."""
    below = " + ".join(f"CAST(ifnull(get({edges}, {i}) < {x}, false) AS BIGINT)" for i in range(most)) or "0L"
    return F.expr(f"CASE WHEN {x} IS NOT NULL THEN {below} END")


def md5_bucket(text: Column, buckets: int = 1_000_000) -> Column:
    """1 + (the 128-bit md5 modulo buckets - 1), from two 64-bit halves."""
    m = F.lit(buckets - 1).cast("decimal(20,0)")
    half = lambda at: F.conv(F.substring(F.md5(text.cast("string")), at, 16), 16, 10).cast("decimal(20,0)")
    shift = F.lit(pow(2, 64, buckets - 1)).cast("decimal(20,0)")
    return (((half(1) % m) * shift + half(17) % m) % m + 1).cast("long")
