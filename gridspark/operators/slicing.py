"""Planes, boxes and points cut out of the cells by pushed-down filters."""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ieee import is_finite
from ..functions.scalars import lon_convention, norm_lon
from ..model import GridError, GridSet
from .catalog import leading_axes
from .joins import lookup_join


#: End of a window that reaches to the end of its axis: the largest index a cell can have, plus one.
OPEN_END = 2**31 - 1


@dataclass(frozen=True)
class Bounds:
    """Half-open window of rows and columns."""

    r0: int
    r1: int
    c0: int
    c1: int

    def __post_init__(self):
        if not (0 <= self.r0 < self.r1 and 0 <= self.c0 < self.c1):
            raise GridError("bounds must be non-empty and start at or after zero")

    def clamp(self, rows: int, cols: int) -> "Bounds":
        return Bounds(self.r0, min(self.r1, rows), self.c0, min(self.c1, cols))

    def test(self) -> Column:
        r, c = F.col("r"), F.col("c")
        return (r >= self.r0) & (r < self.r1) & (c >= self.c0) & (c < self.c1)


@dataclass(frozen=True)
class Shape:
    n_time: int
    n_depth: int
    n_rows: int
    n_cols: int


def shape_of(gs: GridSet, variable: str, dataset_id: int) -> Shape:
    """Axis lengths of one variable, read from the catalogue (one row)."""
    if gs.vars is None or gs.dims is None:
        raise GridError("this request needs the vars and dims tables")
    one = gs.vars.filter((F.col("variable") == variable) & (F.col("dataset_id") == dataset_id))
    row = leading_axes(one, gs.dims.filter(F.col("dataset_id") == dataset_id)).select(
        "n_time", "n_depth", "n_rows", "n_cols"
    ).first()
    if row is None:
        raise GridError(f"variable {variable} is unavailable in dataset {dataset_id}")
    return Shape(*row)


def axis_index(index: int, length: int, axis: str = "axis") -> int:
    """Index on an axis: a static axis (length <= 1) always gives 0."""
    if length <= 1:
        return 0
    if not 0 <= index < length:
        raise GridError(f"{axis} index {index} is outside 0..{length - 1}")
    return index


def axis_index_column(index: Column, length: Column) -> Column:
    """Column form of :func:`axis_index`; NULL when out of range."""
    return F.when(length <= 1, F.lit(0)).when((index >= 0) & (index < length), index)


def plane(
    gs: GridSet, variable: str, t: int = 0, z: int = 0, bounds: Bounds | None = None, dataset_id: int = 1
) -> DataFrame:
    """Cells of one time and level, optionally windowed.  Out of range is an error."""
    shape = shape_of(gs, variable, dataset_id)
    t, z = axis_index(t, shape.n_time, "time"), axis_index(z, shape.n_depth, "level")
    rows = gs.variable(variable, dataset_id).filter((F.col("t") == t) & (F.col("z") == z))
    if bounds is None:
        return rows
    if bounds.r1 > shape.n_rows or bounds.c1 > shape.n_cols:
        raise GridError(f"window {bounds} exceeds the grid {shape.n_rows} x {shape.n_cols}")
    return rows.filter(bounds.test())


def plane_on(
    df: DataFrame, row_dim: str, col_dim: str, fixed: dict[str, int], lengths: dict[str, int] | None = None
) -> DataFrame:
    """Plane over any two index columns, all others fixed.

    An index of a further dimension (a key of the ``extra`` map) is clamped to the end
    of that dimension when ``lengths`` gives its length.
    """
    if row_dim == col_dim:
        raise GridError("x and y axes must be distinct")
    base = [c for c in ("t", "z", "r", "c") if c in df.columns]

    def index(dim: str) -> Column:
        return F.col(dim) if dim in base else F.try_element_at("extra", F.lit(dim))

    out = df
    for dim, i in fixed.items():
        if dim in (row_dim, col_dim):
            raise GridError(f"{dim} cannot be both shown and fixed")
        if lengths and dim in lengths:
            if dim in base and not 0 <= i < max(lengths[dim], 1):
                raise GridError(f"{dim} index {i} is outside 0..{lengths[dim] - 1}")
            i = max(0, min(i, lengths[dim] - 1))
        out = out.filter(index(dim) == i)
    open_dims = [d for d in base if d not in fixed and d not in (row_dim, col_dim)]
    if open_dims:
        raise GridError(f"dimensions without an index: {', '.join(open_dims)}")
    keep = [c for c in df.columns if c not in (*base, "extra")]
    return out.filter(index(row_dim).isNotNull() & index(col_dim).isNotNull()).select(
        *keep, index(row_dim).alias("r"), index(col_dim).alias("c")
    )


def fix_extra(df: DataFrame, fixed: dict[str, int], lengths: dict[str, int]) -> DataFrame:
    """Keep one index of each further dimension, clamped to its length."""
    out = df
    for dim, i in fixed.items():
        if dim not in lengths:
            raise GridError(f"unknown dimension {dim}")
        out = out.filter(F.try_element_at("extra", F.lit(dim)) == max(0, min(i, lengths[dim] - 1)))
    return out


def point(gs: GridSet, variable: str, r: int, c: int, t: int = 0, z: int = 0, dataset_id: int = 1) -> DataFrame:
    """One cell with its coordinates."""
    return with_coords(plane(gs, variable, t, z, Bounds(r, r + 1, c, c + 1), dataset_id), gs)


# --- geographic boxes -------------------------------------------------------------


def _check_interval(lo: float, hi: float, kind: str) -> None:
    if not (isfinite(lo) and isfinite(hi)):
        raise GridError("bounds must be finite numbers")
    if lo > hi:
        raise GridError("minimum bound must be less than or equal to maximum bound")
    # Admissible degrees.
    limits = {"longitude": (-180.0, 360.0), "latitude": (-90.0, 90.0)}.get(kind)
    if limits and (lo < limits[0] or hi > limits[1]):
        raise GridError(f"{kind} bounds must be between {limits[0]} and {limits[1]} degrees")


def _turn(x: float, positive: bool) -> float:
    """Scalar twin of ``lon_convention`` for the two ends of a request."""
    if positive:
        return x + 360.0 if x < 0.0 else x
    return x - 360.0 if x > 180.0 else x


def request_interval(lo: float, hi: float, kind: str, positive: bool) -> tuple[float, float]:
    """Request in the convention of the axis; refuses intervals that wrap."""
    _check_interval(lo, hi, kind)
    if kind != "longitude":
        return lo, hi
    if hi - lo > 360.0:
        raise GridError("longitude span cannot exceed 360 degrees")
    if hi - lo == 360.0:
        return (0.0, 360.0) if positive else (-180.0, 180.0)
    a, b = _turn(lo, positive), _turn(hi, positive)
    if positive and lo < 0.0 and b == 0.0:
        b = 360.0  # [-90, 0] means [270, 360]
    if a > b:
        raise GridError("longitude interval crosses the seam of the axis; split the request")
    return a, b


def _two_dim_request(coords: DataFrame, lon: tuple[float, float]) -> tuple[float, float, bool]:
    """Request and whether it is in 0..360; coordinates on both sides of 0..180 take it in either convention."""
    x = F.col("lon")
    facts = coords.filter(is_finite(x)).agg(F.bool_or(x > 180.0).alias("east"), F.bool_or(x < 0.0).alias("west")).first()
    positive = bool(facts["east"])
    try:
        return *request_interval(*lon, "longitude", positive), positive
    except GridError:
        if not (positive and facts["west"]):
            raise
        return *request_interval(*lon, "longitude", False), False


def bbox_axis(axis: DataFrame, lo: float, hi: float, kind: str = "linear") -> DataFrame:
    """First and last index whose coordinate lies in ``[lo, hi]``, per dataset.

    ``axis``: dataset_id, idx, coord.  Works for ascending and descending axes; the
    envelope includes non-matching indices in between.  For longitudes the convention
    (0..360 or signed) is detected per dataset and the request is converted.
    """
    _check_interval(lo, hi, kind)
    x = F.col("coord")
    finite = axis.filter(is_finite(x))
    ends = [F.min("idx").alias("first"), F.max("idx").alias("last")]
    if kind != "longitude":
        return finite.filter((x >= lo) & (x <= hi)).groupBy("dataset_id").agg(*ends)
    # Both readings of the request are evaluated in one pass; the axis decides.
    tests = {}
    for positive in (False, True):
        try:
            a, b = request_interval(lo, hi, kind, positive)
        except GridError:
            tests[positive] = None
            continue
        y = lon_convention(x, "positive" if positive else "signed")
        tests[positive] = (y >= a) & (y <= b)
    if tests[False] is None and tests[True] is None:
        request_interval(lo, hi, kind, False)
    east = F.bool_or(x > 180.0)
    # an axis on both sides of 0..180 takes a request that wraps in 0..360 as signed
    aggs = [(east if tests[True] is not None else east & ~F.bool_or(x < 0.0)).alias("_positive")]
    for positive, tag in ((False, "s"), (True, "p")):
        hit = F.lit(False) if tests[positive] is None else tests[positive]
        aggs += [F.min(F.when(hit, F.col("idx"))).alias(f"_f{tag}"), F.max(F.when(hit, F.col("idx"))).alias(f"_l{tag}")]
    both = finite.groupBy("dataset_id").agg(*aggs)
    if tests[False] is None or tests[True] is None:
        wrong = F.col("_positive") if tests[True] is None else ~F.col("_positive")
        both = both.withColumn(
            "_positive",
            F.when(
                wrong,
                F.raise_error(F.lit("longitude interval crosses the seam of the axis; split the request")).cast("boolean"),
            ).otherwise(F.col("_positive")),
        )
    return both.select(
        "dataset_id",
        F.when(F.col("_positive"), F.col("_fp")).otherwise(F.col("_fs")).alias("first"),
        F.when(F.col("_positive"), F.col("_lp")).otherwise(F.col("_ls")).alias("last"),
    ).filter("first IS NOT NULL")


def index_box(lo: float, hi: float, length: int) -> tuple[int, int]:
    """Inclusive whole-number indices to first and last index."""
    _check_interval(lo, hi, "index")
    if length == 0 or lo < 0 or hi >= length or lo != int(lo) or hi != int(hi):
        raise GridError(f"index bounds {lo}..={hi} must be whole cells within 0..{max(length - 1, 0)}")
    return int(lo), int(hi)


def bbox_2d(
    coord2d: DataFrame, lon: tuple[float, float], lat: tuple[float, float], by: list[str] | None = None
) -> DataFrame:
    """Row/column envelope of the cells inside a lon/lat box; it may hold other cells too."""
    _check_interval(*lat, "latitude")
    _check_interval(*lon, "longitude")
    a, b, positive = _two_dim_request(coord2d, lon)
    x = lon_convention(F.col("lon"), "positive" if positive else "signed")
    y = F.col("lat")
    inside = is_finite(x) & is_finite(y) & (x >= a) & (x <= b) & (y >= lat[0]) & (y <= lat[1])
    return coord2d.filter(inside).groupBy(*(by or ["dataset_id"])).agg(
        F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"),
    ).withColumn("approximate", F.lit(True))


def bbox(
    gs: GridSet, variable: str, lon: tuple[float, float], lat: tuple[float, float], dataset_id: int = 1
) -> DataFrame:
    """Cells of a variable inside a lon/lat box.

    1-D coordinates give index ranges, 2-D coordinates an envelope; without any
    coordinates the box is read as whole-number column and row indices.  The resulting
    four numbers become a filter on ``r`` and ``c`` that reaches the scan.
    """
    shape = shape_of(gs, variable, dataset_id)
    axes = None
    if gs.axes is not None:
        axes = gs.axes.filter(F.col("dataset_id") == dataset_id)
        names = _plane_dims(gs, variable, dataset_id)
        have = {r["dim"] for r in axes.filter(F.col("dim").isin(list(names))).select("dim").distinct().collect()}
        if have == set(names):
            row_dim, col_dim = names
            y = bbox_axis(axes.filter(F.col("dim") == row_dim), *lat, "latitude").first()
            x = bbox_axis(axes.filter(F.col("dim") == col_dim), *lon, "longitude").first()
            if x is None or y is None:
                raise GridError("bounds do not overlap the coordinate axis")
            box = Bounds(y["first"], y["last"] + 1, x["first"], x["last"] + 1)
            return gs.variable(variable, dataset_id).filter(box.clamp(shape.n_rows, shape.n_cols).test())
    if gs.coord2d is not None:
        env = bbox_2d(gs.coord2d.filter(F.col("dataset_id") == dataset_id), lon, lat).first()
        if env is None:
            raise GridError("geographic bounds do not contain any grid points")
        box = Bounds(env["r0"], env["r1"] + 1, env["c0"], env["c1"] + 1)
    else:
        (c0, c1), (r0, r1) = index_box(*lon, shape.n_cols), index_box(*lat, shape.n_rows)
        box = Bounds(r0, r1 + 1, c0, c1 + 1)
    return gs.variable(variable, dataset_id).filter(box.clamp(shape.n_rows, shape.n_cols).test())


def _plane_dims(gs: GridSet, variable: str, dataset_id: int) -> tuple[str, str]:
    one = gs.vars.filter((F.col("variable") == variable) & (F.col("dataset_id") == dataset_id))
    row = leading_axes(one, gs.dims.filter(F.col("dataset_id") == dataset_id)).select(
        F.get("dims", F.col("row_axis")).alias("y"), F.get("dims", F.col("col_axis")).alias("x")
    ).first()
    return row["y"], row["x"]


# --- coordinates ------------------------------------------------------------------


def with_coords(df: DataFrame, gs: GridSet, row_dim: str = "lat", col_dim: str = "lon") -> DataFrame:
    """Add ``lat`` and ``lon`` (normalised to [-180, 180)); NULL without coordinates.

    2-D coordinates join on (r, c); 1-D axes join on r and on c and never unfold into a
    plane.
    """
    if gs.coord2d is not None:
        return lookup_join(
            df, gs.coord2d.select("dataset_id", "r", "c", "lat", norm_lon(F.col("lon")).alias("lon")),
            ["dataset_id", "r", "c"],
        )
    if gs.axes is not None:
        lat = gs.axes.filter(F.col("dim") == row_dim).select(
            "dataset_id", F.col("idx").alias("r"), F.col("coord").alias("lat")
        )
        lon = gs.axes.filter(F.col("dim") == col_dim).select(
            "dataset_id", F.col("idx").alias("c"), norm_lon(F.col("coord")).alias("lon")
        )
        return lookup_join(lookup_join(df, lat, ["dataset_id", "r"]), lon, ["dataset_id", "c"])
    nothing = F.lit(None).cast("double")
    return df.withColumn("lat", nothing).withColumn("lon", nothing)


def north_up(df: DataFrame, orientation: DataFrame, n_rows: DataFrame) -> DataFrame:
    """Add ``display_row``: rows counted from the north.

    ``orientation``: dataset_id, lat_ascending; ``n_rows``: dataset_id, rows.
    """
    facts = orientation.join(n_rows, "dataset_id")
    flipped = F.col("rows") - 1 - F.col("r")
    return lookup_join(df, facts, ["dataset_id"]).withColumn(
        "display_row", F.when(F.coalesce("lat_ascending", F.lit(False)), flipped).otherwise(F.col("r")).cast("int")
    ).drop("lat_ascending", "rows")


def mesh_plane(
    mesh_values: DataFrame, variable: str, t: int = 0, z: int = 0, dataset_id: int = 1,
    fixed: dict[str, int] | None = None, n_time: int | None = None, n_depth: int | None = None,
) -> DataFrame:
    """Values of one time, level and set of further indices along the mesh axis.

    With the axis lengths given, an index out of range is an error, as for :func:`plane`.
    """
    t = t if n_time is None else axis_index(t, n_time, "time")
    z = z if n_depth is None else axis_index(z, n_depth, "level")
    rows = mesh_values.filter(
        (F.col("dataset_id") == dataset_id) & (F.col("variable") == variable) & (F.col("t") == t) & (F.col("z") == z)
    )
    for dim, i in (fixed or {}).items():
        rows = rows.filter(F.try_element_at("extra", F.lit(dim)) == i)
    return rows
