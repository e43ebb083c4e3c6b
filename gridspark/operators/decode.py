"""Unpacking and classification of packed cells, and the masks that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ieee import INF, NAN, is_finite
from ..model import FILL, FINITE, INVALID_RANGE, MISSING, NEG_INF, POS_INF, GridError
from ..model import NAN as NAN_CLASS
from .joins import lookup_join

_ATTRS = ["fill", "missing", "valid_min", "valid_max", "valid_range", "scale_factor", "add_offset"]


def classify(x: Column, otherwise: str = FINITE) -> Column:
    """NaN / PosInf / NegInf / finite class of a number."""
    return (
        F.when(F.isnan(x), NAN_CLASS)
        .when(x == INF, POS_INF)
        .when(x == -INF, NEG_INF)
        .otherwise(otherwise)
    )


def _packed_class(raw: Column, fill: Column, missing: Column, low: Column, high: Column) -> Column:
    # An unset attribute is NULL and its test must not fire; NaN = NaN holds in Spark.
    def hit(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    return (
        F.when(hit(raw == fill), FILL)
        .when(hit(raw == missing), MISSING)
        .when(~F.isnan(raw) & (hit(raw < low) | hit(raw > high)), INVALID_RANGE)
        .otherwise(classify(raw))
    )


def decode(cells: DataFrame, attrs: DataFrame, profile: str = "packed") -> DataFrame:
    """Add ``value`` and ``validity``.

    ``packed``: Fill, Missing, InvalidRange, NaN and infinities in that order, tested
    on the packed value; masked cells are scaled as well.  ``manifest``: everything
    that is not finite, or lies within 1e-9 of the fill value, is Fill.  ``grib``:
    NaN is Missing, infinities stay visible.
    """
    have = set(attrs.columns)
    packing = attrs.select(
        "dataset_id",
        "variable",
        *[
            (F.col(a) if a in have else F.lit(None).cast("array<double>" if a == "valid_range" else "double"))
            .alias(f"_{a}")
            for a in _ATTRS
        ],
    )
    rows = lookup_join(cells, packing, ["dataset_id", "variable"])
    raw = F.col("raw")
    scaled = raw * F.coalesce(F.col("_scale_factor"), F.lit(1.0)) + F.coalesce(F.col("_add_offset"), F.lit(0.0))
    if profile == "packed":
        low = F.coalesce(F.col("_valid_min"), F.try_element_at("_valid_range", F.lit(1)))
        high = F.coalesce(F.col("_valid_max"), F.try_element_at("_valid_range", F.lit(2)))
        validity = _packed_class(raw, F.col("_fill"), F.col("_missing"), low, high)
    elif profile == "manifest":
        apart = F.coalesce(F.abs(raw - F.col("_fill")) > 1e-9, F.lit(True))
        validity = F.when(is_finite(raw) & apart, FINITE).otherwise(FILL)
    elif profile == "grib":
        validity = F.when(F.isnan(raw), MISSING).otherwise(classify(raw))
    else:
        raise GridError(f"unknown decode profile {profile!r}")
    return rows.withColumn("value", scaled).withColumn("validity", validity).drop(*[f"_{a}" for a in _ATTRS])


def finite_value(value: Column | None = None, validity: Column | None = None) -> Column:
    """The value of a Finite cell, NULL for every masked or non-finite one."""
    value = F.col("value") if value is None else value
    validity = F.col("validity") if validity is None else validity
    return F.when((validity == FINITE) & is_finite(value), value)


def visible_value() -> Column:
    """A leaf of a formula: the value of a Finite cell, NULL (missing) otherwise."""
    return F.when(F.col("validity") == FINITE, F.col("value"))


def reclassify(df: DataFrame, column: str = "result") -> DataFrame:
    """Turn a formula result (NULL = missing) into ``value`` and ``validity``."""
    x = F.col(column)
    return df.select(
        *[F.col(c) for c in df.columns if c not in (column, "value", "validity")],
        F.coalesce(x, F.lit(NAN)).alias("value"),
        F.when(x.isNull(), MISSING).otherwise(classify(x)).alias("validity"),
    )


def mask_range(df: DataFrame, low: float, high: float) -> DataFrame:
    """Flag finite cells outside ``[low, high]`` as filtered; they do not become missing."""
    if not (abs(low) < INF and abs(high) < INF and low <= high):
        raise GridError("a value filter needs finite limits with min <= max")
    x = finite_value()
    return df.withColumn("filtered", F.coalesce((x < low) | (x > high), F.lit(False)))


def transpose(df: DataFrame) -> DataFrame:
    """Swap rows and columns of every plane."""
    swap = {"r": "c", "c": "r"}
    return df.select(*[F.col(swap.get(c, c)).alias(c) for c in df.columns])
