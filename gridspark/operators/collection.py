"""Collections: many datasets as one checked timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_label
from ..model import GridSet
from .catalog import leading_axes, with_dim_map
from .joins import cut_lineage, lookup_join
from .ordered import number_rows, with_neighbours

#: Columns of a variable that must agree with its first dataset, besides format and dimension shapes.
COMPARED = ["dims", "numeric", "units", "long_name", "standard_name"]


def frames(gs: GridSet, labels: DataFrame | None = None) -> DataFrame:
    """One row per variable, dataset and local time step: the virtual concatenation.

    ``labels``: dataset_id, t, label (optionally per variable).  A step without a label is
    called ``t=<index>``.  The dataset identity is carried along when there is one.
    """
    steps = leading_axes(gs.vars, gs.dims).select(
        "variable", "dataset_id", F.explode(F.sequence(F.lit(0), F.greatest("n_time", F.lit(1)) - 1)).alias("t")
    )
    if labels is not None:
        on = [c for c in ("variable", "dataset_id", "t") if c in labels.columns]
        steps = steps.join(labels, on, "left")
    else:
        steps = steps.withColumn("label", F.lit(None).cast("string"))
    if gs.datasets is not None and "identity" in gs.datasets.columns:
        steps = steps.join(gs.datasets.select("dataset_id", "identity"), "dataset_id", "left")
    return steps.withColumn("label", F.coalesce("label", F.concat(F.lit("t="), F.col("t").cast("string"))))


def concat(parts: list[GridSet]) -> GridSet:
    """One collection out of several grid sets, by name, without copying data."""

    def union(field: str) -> DataFrame | None:
        tables = [getattr(p, field) for p in parts if getattr(p, field) is not None]
        if not tables:
            return None
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t, allowMissingColumns=True)
        return out

    return GridSet(**{f: union(f) for f in ("cells", "vars", "dims", "attrs", "axes", "coord2d", "datasets")})


def compatibility(gs: GridSet, expand: bool = False) -> DataFrame:
    """Differences of every variable from its first dataset, and the datasets that lack it.

    Result: variable, dataset_id, reference_id, kind (``differs`` or ``missing``), message.
    A run of datasets without the variable is one diagnostic at the first of them; with
    ``expand`` each of them has its own.
    """
    return differences(gs).unionByName(missing_sources(gs) if expand else missing_notes(gs))


def differences(gs: GridSet) -> DataFrame:
    """Compare every variable with its first dataset: one diagnostic per dataset that differs.

    Dimension lengths may differ along time only.
    """
    rows = with_dim_map(gs.vars.select("dataset_id", "variable", *COMPARED), gs.dims)
    fmt = F.lit(None).cast("string").alias("format")
    if gs.datasets is not None:
        rows = rows.join(gs.datasets.select("dataset_id", "format"), "dataset_id", "left")
    else:
        rows = rows.select("*", fmt)
    first = rows.groupBy("variable").agg(
        F.min("dataset_id").alias("reference_id"),
        F.min_by(F.struct("format", *COMPARED, "dim_map"), "dataset_id").alias("_r"),
    )
    return differences_from(rows, first)


def differences_from(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Compare variables with given references, one per variable, row by row.

    ``rows``: variable, dataset_id, format, the columns ``COMPARED`` and dim_map; ``first``: variable,
    reference_id and the same columns as the struct ``_r``.
    """
    both = lookup_join(rows, first, ["variable"], "inner").filter(F.col("dataset_id") != F.col("reference_id"))

    def same_dim(d: Column) -> Column:
        mine, theirs = F.try_element_at("dim_map", d), F.try_element_at("_r.dim_map", d)
        fits = (mine["role"] == theirs["role"]) & ((mine["length"] == theirs["length"]) | (mine["role"] == "time"))
        return F.coalesce(fits, F.lit(False))

    def apart(name: str) -> Column:
        return ~F.col(name).eqNullSafe(F.col(f"_r.{name}"))

    checks = [
        ("format", apart("format")),
        ("dimensions", apart("dims")),
        ("dimension shapes or roles", ~F.forall("dims", same_dim)),
        ("numeric type", apart("numeric")),
        ("units", apart("units")),
        ("long name", apart("long_name")),
        ("standard name", apart("standard_name")),
    ]
    what = F.array_compact(F.array(*[F.when(test, F.lit(text)) for text, test in checks]))
    return both.withColumn("_what", what).filter(F.size("_what") > 0).select(
        "variable", "dataset_id", "reference_id", F.lit("differs").alias("kind"),
        F.format_string(
            "%s: sources %d and %d disagree on %s",
            F.col("variable"), F.col("reference_id"), F.col("dataset_id"), F.array_join("_what", ", "),
        ).alias("message"),
    )


def missing_notes(gs: GridSet) -> DataFrame:
    """The diagnostics of :func:`missing_runs`."""
    alone = F.col("first_id") == F.col("last_id")
    return missing_runs(gs).select(
        "variable", F.col("first_id").alias("dataset_id"), "reference_id", F.lit("missing").alias("kind"),
        F.when(alone, F.format_string("%s: not in source %d", F.col("variable"), F.col("first_id"))).otherwise(
            F.format_string("%s: not in sources %d to %d", F.col("variable"), F.col("first_id"), F.col("last_id"))
        ).alias("message"),
    )


def _gaps(gs: GridSet) -> tuple[DataFrame, DataFrame]:
    """(gaps, numbered): runs of positions (low..high) that a variable lacks, and the position of each dataset.

    Datasets are numbered in order; the gaps between the numbers a variable has are the
    datasets it lacks, so nothing but the variable's own rows is read.
    """
    files = (gs.datasets if gs.datasets is not None else gs.vars).select("dataset_id").distinct()
    numbered = number_rows(files, [], [F.col("dataset_id")], "_pos")
    n_files = numbered.agg(F.count(F.lit(1)).alias("n"))
    seen = gs.vars.select("variable", "dataset_id").distinct()
    partial = (
        seen.groupBy("variable").agg(F.count(F.lit(1)).alias("_n"), F.min("dataset_id").alias("reference_id"))
        .withColumn("_pos", n_files.scalar() + 1).filter(F.col("_n") < F.col("_pos") - 1)
    )
    have = seen.join(partial.select("variable"), "variable", "left_semi")
    have = have.join(numbered, "dataset_id").select("variable", "_pos")
    ends = have.unionByName(partial.select("variable", "_pos"))
    found = with_neighbours(ends, ["variable"], [F.col("_pos")], {"_pos": "_before"})
    low = F.coalesce(F.col("_before"), F.lit(0)) + 1
    found = found.filter(F.col("_pos") - low >= 1).select("variable", low.alias("low"), (F.col("_pos") - 1).alias("high"))
    return found.join(partial.select("variable", "reference_id"), "variable"), numbered


def missing_runs(gs: GridSet) -> DataFrame:
    """Runs of consecutive datasets that lack a variable: variable, reference_id, first_id, last_id, n."""
    gaps, numbered = _gaps(gs)
    first = numbered.select(F.col("_pos").alias("low"), F.col("dataset_id").alias("first_id"))
    last = numbered.select(F.col("_pos").alias("high"), F.col("dataset_id").alias("last_id"))
    return gaps.join(first, "low").join(last, "high").select(
        "variable", "reference_id", "first_id", "last_id", (F.col("high") - F.col("low") + 1).alias("n")
    )


def missing_sources(gs: GridSet) -> DataFrame:
    """The runs of :func:`missing_runs`, one row per dataset."""
    gaps, numbered = _gaps(gs)
    named = gaps.select("variable", "reference_id", F.explode(F.sequence("low", "high")).alias("_pos")).join(numbered, "_pos")
    return named.select(
        "variable", "dataset_id", "reference_id", F.lit("missing").alias("kind"),
        F.format_string(
            "%s: not in source %d", F.col("variable"), F.col("dataset_id")
        ).alias("message"),
    )


def coord_compat(gs: GridSet, variables: DataFrame) -> DataFrame:
    """Axes of a variable's datasets that differ from those of its first dataset.

    ``variables``: variable, dataset_id, dims.  Values must agree within 1e-12 (NaN equals
    NaN) and axes must have the same length.  Each axis value is compared once per
    variable by an equi-join on (dimension, index).
    """
    first = variables.groupBy("variable").agg(F.min("dataset_id").alias("reference_id"))
    named = lookup_join(variables, first, ["variable"], "inner").select(
        "variable", "dataset_id", "reference_id", F.explode("dims").alias("dim")
    )
    # compare dataset pairs, not variables: many variables share the same axes
    wanted = named.filter(F.col("dataset_id") != F.col("reference_id")).select("dataset_id", "reference_id", "dim").distinct()
    sizes = gs.axes.groupBy("dataset_id", "dim").agg(F.count(F.lit(1)).alias("_n"))
    pairs = lookup_join(wanted, sizes, ["dataset_id", "dim"], "inner")
    pairs = lookup_join(
        pairs, sizes.select(F.col("dataset_id").alias("reference_id"), "dim", F.col("_n").alias("_rn")),
        ["reference_id", "dim"], "inner",
    )
    mine = lookup_join(gs.axes, pairs.filter("_n = _rn"), ["dataset_id", "dim"], "inner")
    theirs = gs.axes.select(
        F.col("dataset_id").alias("reference_id"), "dim", "idx", F.col("coord").alias("_ref")
    )
    joined = mine.join(theirs, ["reference_id", "dim", "idx"], "left")
    close = (F.abs(F.col("coord") - F.col("_ref")) <= 1e-12) | (F.isnan("coord") & F.isnan("_ref"))
    unequal = joined.groupBy("dataset_id", "reference_id", "dim").agg(
        F.bool_and(F.coalesce(close, F.lit(False))).alias("_same")
    ).filter(~F.col("_same")).select("dataset_id", "reference_id", "dim")
    wrong = pairs.filter("_n <> _rn").select("dataset_id", "reference_id", "dim").unionByName(unequal)
    return lookup_join(named, wrong, ["dataset_id", "reference_id", "dim"], "inner").select(
        "variable", "dataset_id", "reference_id", "dim",
        F.format_string(
            "%s: sources %d and %d place %s differently",
            F.col("variable"), F.col("reference_id"), F.col("dataset_id"), F.col("dim"),
        ).alias("message"),
    )


def corner_compat(gs: GridSet, variables: DataFrame) -> DataFrame:
    """Datasets whose grid shape or corner coordinates differ from the first dataset's.

    ``variables``: variable, dataset_id.  Uses 2-D coordinates.
    """
    # one number in the order of (r, c), NULL first: aggregates of fixed width are hashed, those of structs would sort all cells
    place = F.shiftleft(F.coalesce("r", F.lit(-(2**31) + 1)).cast("long"), 32) + F.coalesce("c", F.lit(-(2**31))).cast("long")
    ends = [f(name, place).alias(f"{end}_{name}") for end, f in (("first", F.min_by), ("last", F.max_by)) for name in ("lat", "lon")]
    found = gs.coord2d.groupBy("dataset_id").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), *ends)
    corners = F.struct("rows", "cols", *[F.struct(*[F.col(f"{end}_{name}").alias(name) for name in ("lat", "lon")]).alias(end) for end in ("first", "last")])
    grid = cut_lineage(found.select("dataset_id", corners.alias("_m")))
    first = cut_lineage(variables.groupBy("variable").agg(F.min("dataset_id").alias("reference_id")))
    # few datasets are references: their corners go by variable, not by a shuffle on the reference
    theirs = lookup_join(grid.select(F.col("dataset_id").alias("reference_id"), F.col("_m").alias("_r")), first, ["reference_id"], "inner")
    named = lookup_join(variables.select("variable", "dataset_id"), theirs, ["variable"], "inner").filter(
        F.col("dataset_id") != F.col("reference_id")
    )
    both = lookup_join(named, grid, ["dataset_id"], "inner")

    def same(path: str) -> Column:
        a, b = F.col(f"_m.{path}"), F.col(f"_r.{path}")
        return F.coalesce((F.abs(a - b) <= 1e-12) | (F.isnan(a) & F.isnan(b)), a.isNull() & b.isNull())

    shape = (F.col("_m.rows") == F.col("_r.rows")) & (F.col("_m.cols") == F.col("_r.cols"))
    corners = same("first.lat") & same("first.lon") & same("last.lat") & same("last.lon")
    kind = F.when(~shape, "grids of different shapes").when(~corners, "grids in different places")
    return both.withColumn("_kind", kind).filter("_kind IS NOT NULL").select(
        "variable", "dataset_id", "reference_id",
        F.format_string(
            "%s: sources %d and %d have %s",
            F.col("variable"), F.col("reference_id"), F.col("dataset_id"), F.col("_kind"),
        ).alias("message"),
    )


def duplicate_labels(frame_rows: DataFrame) -> DataFrame:
    """Frames whose (variable, label) occurred before, with the previous occurrence."""
    many = frame_rows.groupBy("variable", "label").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    again = frame_rows.select("variable", "dataset_id", "t", "label").join(many, ["variable", "label"], "left_semi")
    pairs = with_neighbours(
        again, ["variable", "label"], [F.col("dataset_id"), F.col("t")],
        {"dataset_id": "previous_dataset", "t": "previous_t"},
    )
    return pairs.filter("previous_dataset IS NOT NULL")


def timeline(frame_rows: DataFrame, incompatible: DataFrame | None = None, active: int | None = None) -> DataFrame:
    """Global time order of the frames of each variable.

    Parsed times first and in order, then dataset, then local index; unparsed labels come
    last.  ``incompatible`` (variable) is isolated to the frames of dataset ``active``.
    """
    rows = frame_rows
    if incompatible is not None:
        bad = incompatible.select("variable").distinct().withColumn("_bad", F.lit(True))
        rows = lookup_join(rows, bad, ["variable"]).filter(
            F.col("_bad").isNull() | (F.col("dataset_id") == F.lit(active))
        ).drop("_bad")
    rows = rows.withColumn("ts", parse_label(F.col("label")))
    numbered = number_rows(
        rows, ["variable"], [F.col("ts").asc_nulls_last(), F.col("dataset_id"), F.col("t")], "_n"
    )
    keep = [c for c in frame_rows.columns if c not in ("variable", "dataset_id", "t", "label")]
    return numbered.select(
        "variable", (F.col("_n") - 1).cast("int").alias("t_global"), "dataset_id", "t", "label", "ts", *keep
    )


def placeholder(vars_: DataFrame, timeline_rows: DataFrame, active: int) -> DataFrame:
    """One row for each variable of the active dataset that has no timeline at all."""
    lacking = vars_.filter(F.col("dataset_id") == active).select("variable", "dataset_id").join(
        timeline_rows.select("variable").distinct(), "variable", "left_anti"
    )
    return lacking.select(
        "variable", F.lit(0).alias("t_global"), "dataset_id", F.lit(0).alias("t"), F.lit("coordinate index").alias("label")
    )


def earliest(frame_rows: DataFrame) -> DataFrame:
    """The dataset with the smallest time; ties to the lowest id, no time last (one row)."""
    ts = parse_label(F.col("label"))
    return frame_rows.agg(
        F.min(F.struct(ts.isNull().alias("undated"), ts.alias("ts"), F.col("dataset_id"))).alias("_e")
    ).select("_e.dataset_id", "_e.ts")


def agg_label(frame_rows: DataFrame) -> DataFrame:
    """``<first> to <last>`` label of each variable and dataset reduced over time."""
    return frame_rows.groupBy("variable", "dataset_id").agg(
        F.concat(F.min_by("label", "t"), F.lit(" to "), F.max_by("label", "t")).alias("label")
    )
