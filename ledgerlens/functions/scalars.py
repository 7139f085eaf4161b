"""Row functions: texts, losses, times, kinds of types."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DayTimeIntervalType, FractionalType, IntegralType, TimestampNTZType, TimestampType

#: Beyond this the logistic function is not told from 0 or 1 (fixed value).
SIGMOID_BOUND = 35.0


def md5_text(value: Column) -> Column:
    """Hex md5 of a value's text."""
    return F.md5(value.cast("string"))


def percent_text(x: Column) -> Column:
    """A share as a percentage with two decimals; null and NaN stay."""
    return F.when(F.isnan(x), F.lit("NaN")).otherwise(F.when(x.isNotNull(), F.format_string("%.2f%%", 100 * x)))


def range_text(low: Column, high: Column, decimals: int | None = 3) -> Column:
    """`[ low , high ]`, or the one value where both are equal; null for null."""
    show = (lambda x: F.format_string(f"%.{decimals}f", x.cast("double"))) if decimals is not None else (lambda x: x.cast("string"))
    return F.when(low == high, show(low)).when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("[ "), show(low), F.lit(" , "), show(high), F.lit(" ]")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bounded_sigmoid(x: Column) -> Column:
    return sigmoid(F.greatest(F.lit(-SIGMOID_BOUND), F.least(F.lit(SIGMOID_BOUND), x)))


def squared_loss(y: Column, p: Column) -> Column:
    return (y - p) * (y - p)


def absolute_loss(y: Column, p: Column) -> Column:
    """Distance of the exponentials of both."""
    return F.abs(F.exp(y) - F.exp(p))


def log_loss(y: Column, p: Column) -> Column:
    """Of a probability, which must lie between 0 and 1."""
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def exponential_loss(y: Column, p: Column) -> Column:
    return F.exp(-y * p)


def dot(a: Column, b: Column) -> Column:
    """Scalar product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days between two times."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000).cast("long")


def seconds_of_day(start: Column, end: Column) -> Column:
    """Whole seconds beyond the whole days between two times, 0 to 86,399."""
    return F.pmod(F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000), F.lit(86_400)).cast("long")


def epoch_nanoseconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def is_infinite(x: Column, sign: int) -> Column:
    return F.coalesce(x == F.lit(math.inf if sign > 0 else -math.inf), F.lit(False))


def is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), F.lit(False))


def kind_of(kind: DataType) -> str:
    """INT (also booleans and times), FLOAT or STRING."""
    if isinstance(kind, (IntegralType, BooleanType, DateType, TimestampType, TimestampNTZType, DayTimeIntervalType)):
        return "INT"
    return "FLOAT" if isinstance(kind, FractionalType) else "STRING"


def index_band(index: Column) -> Column:
    """3 above 110, 1 below 90, else 2 (fixed values)."""
    return F.when(index > 110, 3).when(index < 90, 1).when(index.isNotNull(), 2)


def chi2_p(stat: Column, terms: int = 120) -> Column:
    """P value of a chi-square statistic of one degree of freedom: erfc(sqrt(stat/2)), by its series; 0 above 80."""
    # erf(x) = 2/sqrt(pi) exp(-x^2) sum of x (2x^2)^n / (1 3 5 ... (2n+1)), with 2x^2 = stat.
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, lambda a, n: F.struct((a["t"] * stat / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * stat / (2 * n + 1)).alias("s")), lambda a: a["s"])
    return F.when(stat > 80, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.sqrt(2 * stat / F.lit(math.pi)) * F.exp(-stat / 2) * total))
