"""Differences of datasets, one by one or set against set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ieee import NAN
from ..model import CELL_KEY, FINITE, MISSING, GridSet
from .catalog import with_dim_map
from .decode import finite_value
from .joins import lookup_join
from .ordered import number_rows


def comparable_variables(gs: GridSet, pairs: DataFrame) -> DataFrame:
    """Variables both datasets of a pair share with equal dimensions and lengths.

    ``pairs``: pair, a, b (dataset ids).  Rank-one and non-numeric variables are left out.
    """
    rows = with_dim_map(gs.vars.filter(F.col("numeric") & (F.size("dims") >= 2)), gs.dims)
    rows = rows.select(
        "dataset_id", "variable", "dims",
        F.transform("dims", lambda d: F.try_element_at("dim_map", d)["length"]).alias("_len"),
    ).filter(~F.exists("_len", lambda n: n.isNull()))
    left = rows.select(F.col("dataset_id").alias("a"), "variable", "dims", "_len")
    right = rows.select(F.col("dataset_id").alias("b"), "variable", "dims", "_len")
    return (
        lookup_join(left, pairs, ["a"], "inner")
        .join(right, ["b", "variable", "dims", "_len"])
        .select("pair", "a", "b", "variable")
    )


def diff_cells(cells: DataFrame, pairs: DataFrame, emit_missing: bool = True) -> DataFrame:
    """``a - b`` where both cells are finite, Missing elsewhere.

    ``pairs``: pair, a, b, variable.  Both sides of a pair are brought together by one
    aggregation on the cell key, so hot variables combine before the shuffle.  With
    ``emit_missing`` the cells present on one side only are kept as Missing.
    """
    sides = pairs.select(
        "pair", "variable",
        F.explode(F.array(
            F.struct(F.col("a").alias("dataset_id"), F.lit(True).alias("_is_a")),
            F.struct(F.col("b").alias("dataset_id"), F.lit(False).alias("_is_a")),
        )).alias("_s"),
    ).select("pair", "variable", "_s.dataset_id", "_s._is_a")
    rows = lookup_join(cells, sides, ["dataset_id", "variable"], "inner").withColumn("_x", finite_value())
    both = rows.groupBy("pair", "variable", *CELL_KEY).agg(
        F.max(F.when(F.col("_is_a"), F.col("_x"))).alias("_a"),
        F.max(F.when(~F.col("_is_a"), F.col("_x"))).alias("_b"),
    )
    delta = F.col("_a") - F.col("_b")
    out = both.select(
        "pair", "variable", *CELL_KEY, F.coalesce(delta, F.lit(NAN)).alias("value"),
        F.when(delta.isNotNull(), FINITE).otherwise(MISSING).alias("validity"),
    )
    return out if emit_missing else out.filter(F.col("validity") == FINITE)


def diff(gs: GridSet, a: int, b: int, emit_missing: bool = True) -> DataFrame:
    """Difference of two datasets over all comparable variables."""
    spark = gs.cells.sparkSession
    pairs = spark.createDataFrame([(1, a, b)], "pair INT, a INT, b INT")
    return diff_cells(gs.cells, comparable_variables(gs, pairs), emit_missing).drop("pair")


def pair_sets(set_a: DataFrame, set_b: DataFrame, order: str = "path") -> DataFrame:
    """Pair the members of two sets: n:n by position, 1:n and n:1, else the shorter.

    Each set (``dataset_id`` and the ``order`` column) is deduplicated and sorted first.
    """

    def numbered(rows: DataFrame, side: str) -> DataFrame:
        unique = rows.groupBy(order).agg(F.min("dataset_id").alias(side))
        return number_rows(unique, [], [F.col(order)], "pair").select("pair", side)

    left, right = numbered(set_a, "a"), numbered(set_b, "b")
    n_left, n_right = left.count(), right.count()
    if n_left == n_right or (n_left > 1 and n_right > 1):
        return left.join(right, "pair").select(F.col("pair").cast("int").alias("pair"), "a", "b")
    if n_right == 1:
        only = right.first()["b"]
        return left.select(F.col("pair").cast("int").alias("pair"), "a", F.lit(only).alias("b"))
    if n_left == 1:
        only = left.first()["a"]
        return right.select(F.col("pair").cast("int").alias("pair"), F.lit(only).alias("a"), "b")
    return left.join(right, "pair").select(F.col("pair").cast("int").alias("pair"), "a", "b")


def diff_sets(gs: GridSet, set_a: DataFrame, set_b: DataFrame, order: str = "path") -> DataFrame:
    """Differences of the paired members of two sets of datasets."""
    pairs = pair_sets(set_a, set_b, order)
    return diff_cells(gs.cells, comparable_variables(gs, pairs))
