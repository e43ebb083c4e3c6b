"""Block means, colour limits and colours."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ieee import is_finite
from ..model import PLANE_KEY, GridError
from .decode import finite_value
from .joins import cut_lineage, lookup_join
from .slicing import Bounds

# Colours of masked and of filtered cells.
MASKED_RGB = (80, 80, 80)
FILTERED_RGB = (30, 30, 46)
_STEPS = 256


def fit_size(rows: int, cols: int, max_rows: int, max_cols: int) -> tuple[int, int]:
    """Output size that keeps the aspect ratio and never enlarges."""
    scale = min(max_rows / rows, max_cols / cols, 1.0)
    half_up = lambda x: int(x + 0.5)
    return (
        min(max(half_up(rows * scale), 1), max(rows, 1)),
        min(max(half_up(cols * scale), 1), max(cols, 1)),
    )


def block_of(index: Column, length: int, blocks: int) -> Column:
    """Block i covers ``i*length//blocks .. (i+1)*length//blocks - 1``."""
    return F.floor(((index + 1).cast("long") * blocks - 1) / length).cast("int")


def bin_grid(
    df: DataFrame, rows: int, cols: int, max_rows: int, max_cols: int,
    limits: tuple[float, float] | None = None, lat_ascending: bool = False, by: list[str] | None = None,
    keep_rows: bool = False,
) -> DataFrame:
    """Mean of the finite cells of each block of a plane, north row first.

    With ``keep_rows`` the limit on columns does not make fewer block rows.  A value filter ``limits`` acts on cells before the mean.  ``filtered`` marks blocks
    whose only finite cells were filtered out; other blocks without cells have NULL.
    """
    by = PLANE_KEY if by is None else by
    out_rows, out_cols = fit_size(rows, cols, max_rows, max_cols)
    if keep_rows:
        out_rows = min(rows, max_rows)
    r = F.lit(rows - 1) - F.col("r") if lat_ascending else F.col("r")
    x = finite_value()
    if limits is None:
        shown, hidden = x, F.lit(False)
    else:
        low, high = limits
        if not (isfinite(low) and isfinite(high) and low <= high):
            raise GridError("a value filter needs finite limits with min <= max")
        hidden = F.coalesce((x < low) | (x > high), F.lit(False))
        shown = F.when(~hidden, x)
    return df.groupBy(
        *by, block_of(r, rows, out_rows).alias("bin_r"), block_of(F.col("c"), cols, out_cols).alias("bin_c")
    ).agg(
        F.avg(shown).alias("value"), F.count(shown).alias("cells"),
        (F.bool_or(hidden) & (F.count(shown) == 0)).alias("filtered"),
    )


def limits(df: DataFrame, by: list[str], scale: str = "linear", is_diff: bool = False, pad: bool = True) -> DataFrame:
    """Colour limits of each group: ``lo`` and ``hi``, NULL when there is no usable value.

    Linear: finite min and max.  Log: positive values; log of a difference: magnitudes.
    A constant field is widened by half its magnitude (at least half of one) on the linear scale.
    """
    x = finite_value()
    if scale == "log":
        x = F.abs(x) if is_diff else x
        x = F.when(x > 0, x)
    elif scale != "linear":
        raise GridError(f"unknown scale {scale!r}")
    out = df.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    if not pad or scale == "log":  # widening could leave the scale
        return out
    margin = F.greatest(F.abs("lo"), F.lit(1.0)) * 0.5
    flat = F.col("hi") <= F.col("lo")
    return out.select(
        *by, F.when(flat, F.col("lo") - margin).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + margin).otherwise(F.col("hi")).alias("hi"),
    )


def scoped_limits(
    df: DataFrame, by: list[str], window: Bounds | None = None, scope: str = "current",
    manual: tuple[float, float] | None = None, scale: str = "linear", is_diff: bool = False,
) -> DataFrame:
    """Limits of the current window or the whole plane; manual limits win.

    The global scope falls back to the window when the plane has no usable value.
    """
    if manual is not None:
        if not manual[0] < manual[1]:
            raise GridError("manual limits need min < max")
        return df.select(*by).distinct().select(*by, F.lit(manual[0]).alias("lo"), F.lit(manual[1]).alias("hi"))
    x = finite_value()
    if scale == "log":
        x = F.abs(x) if is_diff else x
        x = F.when(x > 0, x)
    inside = F.when(window.test(), x) if window is not None else x
    both = df.groupBy(*by).agg(
        F.min(x).alias("_glo"), F.max(x).alias("_ghi"), F.min(inside).alias("_wlo"), F.max(inside).alias("_whi")
    )
    if scope == "current":
        return both.select(*by, F.col("_wlo").alias("lo"), F.col("_whi").alias("hi"))
    if scope == "global":
        return both.select(*by, F.coalesce("_glo", "_wlo").alias("lo"), F.coalesce("_ghi", "_whi").alias("hi"))
    raise GridError(f"unknown limit scope {scope!r}")


def normalise_value(x: Column, lo: Column, hi: Column, scale: str = "linear", is_diff: bool = False) -> Column:
    """Position in [0, 1]; 0.5 when the limits are degenerate, NULL off the log scale."""
    if scale == "log":
        x = F.abs(x) if is_diff else x
        usable = (x > 0) & (lo > 0) & (hi > 0)
        x, lo, hi = (F.log10(F.when(usable, v)) for v in (x, lo, hi))
    width = hi - lo
    spot = F.least(F.greatest(F.try_divide(x - lo, width), F.lit(0.0)), F.lit(1.0))
    sound = is_finite(x) & is_finite(lo) & is_finite(hi) & (hi > lo)
    return F.when(sound, spot).when(x.isNotNull() & lo.isNotNull(), F.lit(0.5))


def normalise(
    df: DataFrame, plane_limits: DataFrame, by: list[str], scale: str = "linear", is_diff: bool = False
) -> DataFrame:
    """Add ``norm`` to each cell from the limits of its group; NULL for masked cells."""
    # computed once: counting and joining the limits must not scan the cells twice
    joined = lookup_join(df, cut_lineage(plane_limits), by)
    return joined.withColumn(
        "norm", normalise_value(finite_value(), F.col("lo"), F.col("hi"), scale, is_diff)
    )


def colour_table(palettes: DataFrame, reverse: bool = False) -> DataFrame:
    """256-step table of each palette by linear interpolation between its entries.

    ``palettes``: name, idx, red, green, blue.
    """
    by_name = Window.partitionBy("name")  # a palette has a few hundred entries
    entries = palettes.withColumn("_last", F.max("idx").over(by_name))
    if reverse:
        entries = entries.withColumn("idx", F.col("_last") - F.col("idx"))
    steps = entries.select("name", "_last").distinct().withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(_STEPS - 1)))
    )
    pos = F.col("step") / F.lit(float(_STEPS - 1)) * F.col("_last")
    steps = steps.select(
        "name", "step", (pos - F.floor(pos)).alias("_f"), F.floor(pos).cast("int").alias("_a"), F.ceil(pos).cast("int").alias("_b")
    )
    a = entries.select("name", F.col("idx").alias("_a"), *[F.col(c).alias(f"_a{c}") for c in ("red", "green", "blue")])
    b = entries.select("name", F.col("idx").alias("_b"), *[F.col(c).alias(f"_b{c}") for c in ("red", "green", "blue")])
    mixed = steps.join(a, ["name", "_a"]).join(b, ["name", "_b"])

    def mix(c: str) -> Column:
        low, high = F.col(f"_a{c}").cast("double"), F.col(f"_b{c}").cast("double")
        return F.round(low + (high - low) * F.col("_f")).cast("int").alias(c)

    return mixed.select("name", F.col("step").alias("idx"), mix("red"), mix("green"), mix("blue"))


def colourise(
    df: DataFrame, plane_limits: DataFrame, by: list[str], palettes: DataFrame, palette: str,
    scale: str = "linear", is_diff: bool = False, value_filter: tuple[float, float] | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Colour index and RGB of every cell; grey for masked, dark for filtered cells."""
    table = colour_table(palettes.filter(F.col("name") == palette), reverse).drop("name")
    rows = normalise(df, plane_limits, by, scale, is_diff)
    rows = rows.withColumn("colour", F.round(F.col("norm") * float(_STEPS - 1)).cast("int"))
    # the table has 256 rows
    rows = rows.join(F.broadcast(table.withColumnRenamed("idx", "colour")), "colour", "left")
    x = finite_value()
    hidden = F.lit(False) if value_filter is None else F.coalesce(
        (x < value_filter[0]) | (x > value_filter[1]), F.lit(False)
    )
    out = rows
    for i, c in enumerate(("red", "green", "blue")):
        out = out.withColumn(
            c, F.when(hidden, FILTERED_RGB[i]).otherwise(F.coalesce(F.col(c), F.lit(MASKED_RGB[i])))
        )
    return out.drop("lo", "hi")


