"""Series: cross-sections, point time series, domain summaries and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ieee import NAN, is_finite
from ..functions.scalars import norm_lon, point_label
from ..model import GridSet
from .decode import finite_value
from .joins import cut_lineage, lookup_join
from .slicing import Bounds, with_coords

_DIM_KEY = {"time": "t", "depth": "z", "latitude": "r", "longitude": "c"}


def label_points(points: DataFrame, gs: GridSet, row_dim: str = "lat", col_dim: str = "lon") -> DataFrame:
    """Add ``label`` to points (``dataset_id, point, r, c``; ``point`` numbers them from one).

    A label already used by an earlier point gets `` #<point>``.
    """
    placed = with_coords(points, gs, row_dim, col_dim)
    base = placed.withColumn("_base", point_label(F.col("lat"), F.col("lon"), F.col("r"), F.col("c")))
    first = cut_lineage(base.groupBy("_base").agg(F.min("point").alias("_first")))
    again = F.concat("_base", F.lit(" #"), F.col("point").cast("string"))
    return lookup_join(base, first, ["_base"], "inner").withColumn(
        "label", F.when(F.col("point") > F.col("_first"), again).otherwise(F.col("_base"))
    ).drop("_base", "_first")


def cross_section(
    df: DataFrame, points: DataFrame, dim: str, axis: DataFrame | None = None, length: int | None = None
) -> DataFrame:
    """Values along one dimension through each point, in order of x.

    ``df``: decoded cells.  ``points``: dataset_id, variable, point and an index for every
    cell key but the one of ``dim`` (``time``, ``depth``, ``latitude``, ``longitude``).
    ``axis``: dataset_id, idx, coord.  x is the coordinate, or the index where it is not
    finite.  Given ``length`` (or an axis), absent cells appear as NaN.
    """
    key = _DIM_KEY[dim]
    fixed = [k for k in ("t", "z", "r", "c") if k != key]
    y = F.coalesce(finite_value(), F.lit(NAN))
    through = df.select("dataset_id", "variable", *fixed, F.col(key).alias("idx"), y.alias("y"))
    at = ["dataset_id", "variable", *fixed]
    if length is not None:
        steps = points.select(*at, "point", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("idx"))
    elif axis is not None:
        steps = points.join(axis.select("dataset_id", "idx"), "dataset_id").select(*at, "point", "idx")
    else:
        steps = None
    if steps is None:
        hits = lookup_join(through, points.select(*at, "point"), at, "inner")
    else:
        # keep the steps of every point, and fill in the cells that exist
        hit = lookup_join(through, points.select(*at).distinct(), at, "left_semi")
        hits = steps.join(hit, [*at, "idx"], "left").withColumn("y", F.coalesce("y", F.lit(NAN)))
    x = F.col("idx").cast("double")
    if axis is not None:
        coord = norm_lon(F.col("coord")) if dim == "longitude" else F.col("coord")
        hits = lookup_join(hits, axis.select("dataset_id", "idx", coord.alias("_coord")), ["dataset_id", "idx"])
        x = F.when(is_finite(F.col("_coord")), F.col("_coord")).otherwise(x)
    return hits.select("dataset_id", "variable", "point", *fixed, "idx", x.alias("x"), "y").orderBy(
        "dataset_id", "variable", "point", "x"
    )


def profile(df: DataFrame, points: DataFrame, axis: DataFrame | None = None) -> DataFrame:
    """Vertical profile: value on x, level on y."""
    rows = cross_section(df, points, "depth", axis)
    return rows.withColumnsRenamed({"x": "level", "y": "value"})


def time_series(
    cells: DataFrame, timeline: DataFrame, points: list[tuple[int, int]], z: int = 0
) -> DataFrame:
    """Value of each picked point at every step of a timeline; gaps are NaN.

    ``timeline``: variable, t_global, dataset_id, t, label.  ``points``: (row, column)
    pairs picked by the user; they are numbered from one.
    """
    spark = cells.sparkSession
    rows = [(i + 1, int(r), int(c)) for i, (r, c) in enumerate(points)]
    picks = spark.createDataFrame(rows, "point INT, r INT, c INT")
    # the picks come from the caller, so their number is known here
    wanted = cells.filter(F.col("z") == z).join(
        F.broadcast(picks.select("r", "c").distinct()), ["r", "c"], "left_semi"
    ).select("dataset_id", "variable", "t", "r", "c", finite_value().alias("_v"))
    each = F.array(*[
        F.struct(F.lit(p).alias("point"), F.lit(r).alias("r"), F.lit(c).alias("c")) for p, r, c in rows
    ])
    steps = timeline.withColumn("_p", F.explode(each)).select(*timeline.columns, "_p.*")
    hits = steps.join(wanted, ["dataset_id", "variable", "t", "r", "c"], "left")
    return hits.select(
        "variable", "point", "r", "c", F.col("t_global").alias("x"), F.coalesce("_v", F.lit(NAN)).alias("y"), "label"
    )


def series_summary(series: DataFrame, by: list[str]) -> DataFrame:
    """Finite and total samples of each series."""
    return series.groupBy(*by).agg(
        F.count(F.when(is_finite(F.col("y")), 1)).alias("finite_samples"), F.count(F.lit(1)).alias("samples")
    )


def domain_summary(cells: DataFrame, timeline: DataFrame, z: int = 0, bounds: Bounds | None = None) -> DataFrame:
    """Mean, minimum and maximum per timeline step over the grid or a window; NaN when empty."""
    rows = cells.filter(F.col("z") == z)
    if bounds is not None:
        rows = rows.filter(bounds.test())
    x = finite_value()
    per = rows.groupBy("dataset_id", "variable", "t").agg(
        F.avg(x).alias("mean"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.count(x).alias("finite_count")
    )

    def or_nan(name: str) -> Column:
        return F.coalesce(name, F.lit(NAN)).alias(name)

    return timeline.join(per, ["dataset_id", "variable", "t"], "left").select(
        "variable", "t_global", "label", or_nan("mean"), or_nan("minimum"), or_nan("maximum"),
        F.coalesce("finite_count", F.lit(0)).alias("finite_count"),
    )


def scatter(series: DataFrame) -> DataFrame:
    """The (x, y) pairs of a series in which both numbers are finite."""
    return series.filter(is_finite(F.col("x")) & is_finite(F.col("y")))
