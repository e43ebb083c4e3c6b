"""Statistics of planes and reductions over time or level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ieee import poisoned_max, poisoned_min
from ..model import FULL_KEY, PLANE_KEY, GridError
from .decode import finite_value, reclassify, visible_value

_REDUCERS = {"mean": F.avg, "sum": F.sum, "min": poisoned_min, "max": poisoned_max}
_AXES = {"time": "t", "layer": "z"}


def stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Min, max, mean and count over the finite cells of each group."""
    x = finite_value()
    return df.groupBy(*(PLANE_KEY if by is None else by)).agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
        F.count(x).alias("finite_count"),
    )


def reducer(how: str, x: Column) -> Column:
    """Aggregate that skips missing (NULL) and lets NaN through."""
    if how not in _REDUCERS:
        raise GridError(f"unknown reduction {how!r}")
    return _REDUCERS[how](x)


def reduce_column(df: DataFrame, column: str, axis: str, how: str, name: str | None = None) -> DataFrame:
    """Reduce a formula column (NULL = missing) over ``time`` or ``layer``.

    Partial aggregates combine before the shuffle; every other key column stays.
    """
    gone = _AXES[axis]
    keys = [k for k in FULL_KEY if k in df.columns and k != gone]
    return df.groupBy(*keys).agg(reducer(how, F.col(column)).alias(name or column))


def reduce_axis(df: DataFrame, axis: str, how: str) -> DataFrame:
    """Reduce decoded cells over ``time`` or ``layer`` to ``value`` and ``validity``."""
    leaf = df.withColumn("result", visible_value())
    return reclassify(reduce_column(leaf, "result", axis, how))


def time_mean(df: DataFrame) -> DataFrame:
    return reduce_axis(df, "time", "mean")


def time_sum(df: DataFrame) -> DataFrame:
    return reduce_axis(df, "time", "sum")


def time_min(df: DataFrame) -> DataFrame:
    return reduce_axis(df, "time", "min")


def time_max(df: DataFrame) -> DataFrame:
    return reduce_axis(df, "time", "max")


def layer_mean(df: DataFrame) -> DataFrame:
    return reduce_axis(df, "layer", "mean")


def layer_sum(df: DataFrame) -> DataFrame:
    return reduce_axis(df, "layer", "sum")


def layer_min(df: DataFrame) -> DataFrame:
    return reduce_axis(df, "layer", "min")


def layer_max(df: DataFrame) -> DataFrame:
    return reduce_axis(df, "layer", "max")
