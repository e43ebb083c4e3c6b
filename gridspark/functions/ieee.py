"""IEEE-754 arithmetic on ``DOUBLE`` columns.

Spark SQL in ANSI mode raises on division by zero and returns NULL for the
logarithm of a non-positive number.  Grid formulas need the IEEE results
instead: NULL means *missing*, while NaN and the infinities are visible values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def ieee_div(a, b) -> Column:
    """``a / b`` with signed infinities and NaN instead of an error."""
    a, b = as_column(a), as_column(b)
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def ieee_log(x) -> Column:
    x = as_column(x)
    return (
        F.when(F.isnan(x) | (x < 0), F.lit(NAN))
        .when(x == 0, F.lit(-INF))
        .otherwise(F.log(x))
    )


def ieee_log10(x) -> Column:
    x = as_column(x)
    return (
        F.when(F.isnan(x) | (x < 0), F.lit(NAN))
        .when(x == 0, F.lit(-INF))
        .otherwise(F.log10(x))
    )


def ieee_pow(a, b) -> Column:
    return F.pow(as_column(a), as_column(b))


def is_finite(x: Column) -> Column:
    """True for ordinary numbers; false for NaN and infinities; NULL stays NULL."""
    return ~(F.isnan(x) | (F.abs(x) == F.lit(INF)))


def poisoned_min(x: Column) -> Column:
    """Minimum in which one NaN makes the result NaN (Spark's ``min`` skips NaN)."""
    return F.when(F.max(F.isnan(x) & x.isNotNull()), F.lit(NAN)).otherwise(F.min(x))


def poisoned_max(x: Column) -> Column:
    """Maximum in which one NaN makes the result NaN (Spark orders NaN last)."""
    return F.max(x)
