"""Derived variables: formulas over one or several variables and datasets."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import CELL_KEY, GridError, GridSet
from .catalog import leading_axes
from .decode import reclassify, visible_value
from .joins import cut_lineage, lookup_join
from .reduce import reduce_column

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")


@dataclass(frozen=True)
class Ref:
    """A variable; ``dataset`` (1-based) pins it to one dataset."""

    name: str
    dataset: int | None = None


def ref(name: str, dataset: int | None = None) -> Ref:
    return Ref(name, dataset)


@dataclass(frozen=True)
class Derived:
    """A named formula.  ``expr`` receives one column per reference (NULL = missing).

    ``over`` optionally reduces the result, e.g. ``("time", "mean")``.
    """

    name: str
    refs: tuple[Ref, ...]
    expr: Callable[..., Column]
    over: tuple[str, str] | None = None
    text: str | None = None

    @property
    def anchor(self) -> int | None:
        """Owning dataset when every reference is pinned; None when it runs everywhere."""
        if any(r.dataset is None for r in self.refs):
            return None
        return self.refs[0].dataset


def check_name(name: str) -> None:
    if not _IDENTIFIER.fullmatch(name):
        raise GridError(f"{name!r} is not a valid formula name (use letters, digits, _ or .)")


def plottable_vars(gs: GridSet) -> DataFrame:
    """Numeric variables of rank two or more with their axis lengths."""
    return leading_axes(gs.vars.filter(F.col("numeric") & (F.size("dims") >= 2)), gs.dims)


def _shapes(gs: GridSet, d: Derived) -> DataFrame:
    """Catalogue rows of the referenced variables, tagged with their reference number."""
    wanted = plottable_vars(gs).filter(F.col("variable").isin([r.name for r in d.refs]))
    tagged = []
    for i, r in enumerate(d.refs):
        rows = wanted.filter(F.col("variable") == r.name)
        if r.dataset is not None:
            rows = rows.filter(F.col("dataset_id") == r.dataset)
        tagged.append(rows.withColumn("_ref", F.lit(i)))
    return reduce(DataFrame.unionByName, tagged)


def bind(gs: GridSet, d: Derived, shapes: DataFrame | None = None) -> DataFrame:
    """Per dataset: can it evaluate the formula?  ``dataset_id, accepted, reason``.

    Every reference must resolve to a plottable variable, all grids must have the same
    shape, steps along time (and level) must be equal or one, and the name must be free.
    """
    check_name(d.name)
    if not d.refs:
        raise GridError("formula must reference at least one variable")
    shapes = _shapes(gs, d) if shapes is None else shapes
    pinned = [i for i, r in enumerate(d.refs) if r.dataset is not None]
    free = [i for i, r in enumerate(d.refs) if r.dataset is None]
    everyone = gs.vars.groupBy("dataset_id").agg(F.bool_or(F.col("variable") == d.name).alias("_taken"))
    if d.anchor is not None:
        everyone = everyone.filter(F.col("dataset_id") == d.anchor)

    def facts(rows: DataFrame, by: list[str]) -> DataFrame:
        def over_one(c: str, how) -> Column:
            return how(F.when(F.col(c) > 1, F.col(c)))

        return rows.groupBy(*by).agg(
            F.count_distinct("_ref").alias("n_refs"),
            *[F.min(c).alias(f"lo_{c}") for c in ("n_rows", "n_cols")],
            *[F.max(c).alias(f"hi_{c}") for c in ("n_rows", "n_cols")],
            *[over_one(c, F.min).alias(f"lo_{c}") for c in ("n_time", "n_depth")],
            *[over_one(c, F.max).alias(f"hi_{c}") for c in ("n_time", "n_depth")],
        )

    cols = [f"{e}_{c}" for c in ("n_rows", "n_cols", "n_time", "n_depth") for e in ("lo", "hi")]
    out = everyone
    if free:
        own = facts(shapes.filter(F.col("_ref").isin(free)), ["dataset_id"])
        out = out.join(own, "dataset_id", "left")
    else:
        out = out.withColumn("n_refs", F.lit(0))
        for c in cols:
            out = out.withColumn(c, F.lit(None).cast("int"))
    if pinned:
        one = facts(shapes.filter(F.col("_ref").isin(pinned)), []).first()
        out = out.withColumn("n_refs", F.coalesce("n_refs", F.lit(0)) + (one["n_refs"] or 0))
        for c in cols:
            pick = F.least if c.startswith("lo") else F.greatest
            out = out.withColumn(c, pick(F.col(c), F.lit(one[c]).cast("int")))
    apart = lambda c: F.coalesce(F.col(f"lo_{c}") != F.col(f"hi_{c}"), F.lit(False))
    reason = (
        F.when(F.col("_taken"), f"{d.name} is already a variable name")
        .when(F.coalesce("n_refs", F.lit(0)) < len(d.refs), "a reference is not a plottable variable")
        .when(apart("n_rows") | apart("n_cols"), "referenced grids have different shapes")
        .when(apart("n_time") | apart("n_depth"), "references have different numbers of steps")
    )
    return out.select("dataset_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def _varying(shapes: DataFrame, d: Derived) -> list[tuple[str, ...]]:
    """Cell keys each reference varies over; axes of length one are left out."""
    found = {
        row["_ref"]: row
        for row in shapes.groupBy("_ref").agg(F.max("n_time").alias("nt"), F.max("n_depth").alias("nz")).collect()
    }
    keys = []
    for i in range(len(d.refs)):
        if i not in found:
            keys.append(tuple(CELL_KEY))
            continue
        row = found[i]
        keys.append(tuple(k for k, n in (("t", row["nt"]), ("z", row["nz"]), ("r", 2), ("c", 2)) if n > 1))
    return keys


def _gather(cells: DataFrame, refs: list[tuple[int, Ref]], keys: tuple[str, ...], per_dataset: bool) -> DataFrame:
    """References with the same keys, one column each, in a single aggregation."""
    names = sorted({r.name for _, r in refs})
    picks = []
    for i, r in refs:
        test = F.col("variable") == r.name
        if r.dataset is not None:
            test = test & (F.col("dataset_id") == r.dataset)
        picks.append(F.max(F.when(test, F.col("_leaf"))).alias(f"_x{i}"))
    rows = cells.filter(F.col("variable").isin(names))
    if not per_dataset:
        rows = rows.filter(F.col("dataset_id").isin(sorted({r.dataset for _, r in refs})))
    by = (["dataset_id"] if per_dataset else []) + list(keys)
    return rows.withColumn("_leaf", visible_value()).groupBy(*by).agg(*picks)


def combine(parts: list[DataFrame]) -> DataFrame:
    """Inner equi-join of columns keyed by (some of) dataset_id, t, z, r, c.

    Parts with more keys come first; a part that lacks an axis is reused along it.
    Missing on one side means missing in the result, so inner joins lose nothing.
    """
    all_keys = ["dataset_id", *CELL_KEY]
    key_of = lambda p: [k for k in all_keys if k in p.columns]
    ordered = sorted(parts, key=lambda p: -len(key_of(p)))
    out = ordered[0]
    for p in ordered[1:]:
        shared = [k for k in key_of(p) if k in out.columns]
        out = lookup_join(out, p, shared, "inner") if len(key_of(p)) < len(key_of(out)) else out.join(p, shared)
    return out


def _accept(gs: GridSet, d: Derived) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """Datasets and whether they can evaluate the formula, and the keys of its references; raises if none can."""
    check_name(d.name)
    if not d.refs:
        raise GridError("formula must reference at least one variable")
    # a few columns per dataset and reference, used three times below
    shapes = cut_lineage(_shapes(gs, d).select("_ref", "dataset_id", "n_time", "n_depth", "n_rows", "n_cols"))
    accepted = cut_lineage(bind(gs, d, shapes))
    if not accepted.filter("accepted").take(1):
        why = accepted.select(F.min("reason")).first()[0]
        raise GridError(f"{d.name}: {why or 'dataset is not open'}")
    return accepted, _varying(shapes, d)


def derive(
    gs: GridSet, name: str, refs: list[Ref], expr: Callable[..., Column],
    over: tuple[str, str] | None = None, validate: bool = True,
) -> DataFrame:
    """Cells of a derived variable for every dataset that can evaluate it.

    References over the same axes are brought side by side by one aggregation on the
    cell key, so each is read once and nothing is joined; static fields join on the keys
    they have.
    """
    d = Derived(name, tuple(refs), expr, over)
    if validate and gs.vars is not None and gs.dims is not None:
        accepted, keys = _accept(gs, d)
    else:
        check_name(name)
        accepted, keys = None, [tuple(CELL_KEY)] * len(refs)
    groups: dict[tuple, list[tuple[int, Ref]]] = {}
    for i, r in enumerate(refs):
        groups.setdefault((keys[i], r.dataset is None), []).append((i, r))
    parts = [_gather(gs.cells, members, k, free) for (k, free), members in groups.items()]
    wide = combine(parts)
    if d.anchor is not None:
        wide = wide.withColumn("dataset_id", F.lit(d.anchor))
    elif accepted is not None:
        fit = accepted.filter("accepted").select("dataset_id")
        wide = lookup_join(wide, fit, ["dataset_id"], "left_semi")
    for k in CELL_KEY:
        if k not in wide.columns:
            wide = wide.withColumn(k, F.lit(0))
    result = expr(*[F.col(f"_x{i}") for i in range(len(refs))])
    rows = wide.select("dataset_id", F.lit(name).alias("variable"), *CELL_KEY, result.alias("result"))
    if over is not None:
        axis, how = over
        rows = reduce_column(rows, "result", axis, how)
        rows = rows.withColumn("t" if axis == "time" else "z", F.lit(0))
    return reclassify(rows.select("dataset_id", "variable", *CELL_KEY, "result"))


def derived_vars(gs: GridSet, d: Derived) -> DataFrame:
    """Catalogue rows of a derived variable: dimensions of its first reference.

    Reduced axes disappear; units are unknown and the long name is the formula text.
    """
    first = d.refs[0]
    rows = plottable_vars(gs).filter(F.col("variable") == first.name)
    if first.dataset is not None:
        rows = rows.filter(F.col("dataset_id") == first.dataset)
    gone = {"time": "time_axis", "layer": "depth_axis"}.get(d.over[0]) if d.over else None
    dims = F.col("dims")
    if gone is not None:
        dims = F.filter("dims", lambda _, i: ~F.coalesce(i == F.col(gone), F.lit(False)))
    fit = bind(gs, d).filter("accepted").select("dataset_id")
    return lookup_join(rows, fit, ["dataset_id"], "left_semi").select(
        "dataset_id", F.lit(d.name).alias("variable"), dims.alias("dims"), F.lit(True).alias("numeric"),
        F.lit(None).cast("string").alias("units"), F.lit(d.text or d.name).alias("long_name"),
        F.lit(None).cast("string").alias("standard_name"),
    ).filter(F.size("dims") >= 2)


def apply_formulas(gs: GridSet, definitions: list[Derived]) -> tuple[DataFrame | None, list[str]]:
    """All formulas over all datasets, and one message per formula nobody can evaluate.

    References resolve against the base variables only: formulas do not see each other.
    """
    results, errors, seen = [], [], set()
    together: list[tuple[Derived, tuple[str, ...], DataFrame]] = []
    for d in definitions:
        try:
            if d.name in seen:
                raise GridError(f"{d.name} is already a variable name")
            accepted, keys = _accept(gs, d)
            if len(set(keys)) == 1 and len({r.dataset is None for r in d.refs}) == 1 and d.over is None:
                together.append((d, keys[0], accepted))
            else:
                results.append(derive(gs, d.name, list(d.refs), d.expr, d.over))
            seen.add(d.name)
        except GridError as exc:
            text = str(exc)
            errors.append(text if text.startswith(f"{d.name}:") else f"{d.name}: {text}")
    if together:
        results.insert(0, _side_by_side(gs.cells, together))
    return (reduce(DataFrame.unionByName, results) if results else None), errors


def _side_by_side(cells: DataFrame, formulas: list[tuple[Derived, tuple[str, ...], DataFrame]]) -> DataFrame:
    """Cells of several formulas, each over references of the same keys: one scan and one aggregation.

    A cell goes once to each group of formulas (same keys, all pinned or none) that reads it.  The
    references of a group become columns of one row per key, from which its formulas are stacked.
    """
    groups: dict[tuple, list[Derived]] = {}
    for d, keys, _ in formulas:
        groups.setdefault((keys, d.anchor is not None), []).append(d)
    homes, picks, stacks = [], [], []
    for g, ((keys, pinned), members) in enumerate(groups.items()):
        refs = sorted({r for d in members for r in d.refs}, key=lambda r: (r.name, r.dataset or 0))
        tests = {}
        for r in refs:
            test = F.col("variable") == r.name
            tests[r] = test & (F.col("dataset_id") == r.dataset) if pinned else test
        key = [(F.col(k) if k in keys else F.lit(0)).cast("int").alias(k) for k in CELL_KEY]
        owner = F.lit(None).cast("int") if pinned else F.col("dataset_id").cast("int")
        homes.append(F.when(reduce(Column.__or__, tests.values()), F.struct(F.lit(g).alias("_g"), owner.alias("_owner"), *key)))
        for n, (r, test) in enumerate(tests.items()):
            own = (F.col("_g") == g) & test
            picks += [F.max(F.when(own, F.col("_leaf"))).alias(f"_x{g}_{n}"), F.max(F.when(own, F.lit(1))).alias(f"_p{g}_{n}")]
        rows = []
        for d in members:
            at = [refs.index(r) for r in d.refs]
            present = F.coalesce(*[F.col(f"_p{g}_{n}") for n in at]).isNotNull()
            result = d.expr(*[F.col(f"_x{g}_{n}") for n in at]).cast("double")
            home = F.lit(d.anchor) if pinned else F.col("_owner")
            rows.append(F.when(present, F.struct(home.cast("int").alias("dataset_id"), F.lit(d.name).alias("variable"), result.alias("result"))))
        stacks.append(F.when(F.col("_g") == g, F.array(*rows)))
    names = sorted({r.name for d, _, _ in formulas for r in d.refs})
    dealt = cells.filter(F.col("variable").isin(names)).select("variable", "dataset_id", visible_value().alias("_leaf"), *CELL_KEY)
    dealt = dealt.withColumn("_home", F.explode(F.array_compact(F.array(*homes)))).select("variable", "dataset_id", "_leaf", "_home.*")
    wide = dealt.groupBy("_g", "_owner", *CELL_KEY).agg(*picks)
    long = wide.select(*CELL_KEY, F.explode(F.array_compact(F.coalesce(*stacks))).alias("_f")).select("_f.*", *CELL_KEY)
    # a few rows per dataset and formula
    fits = reduce(DataFrame.unionByName, [a.filter("accepted").select("dataset_id", F.lit(d.name).alias("variable")) for d, _, a in formulas])
    return reclassify(lookup_join(long, fits, ["dataset_id", "variable"], "left_semi").select("dataset_id", "variable", *CELL_KEY, "result"))


def anomaly(df: DataFrame) -> DataFrame:
    """``x - time_mean(x)`` per cell, keeping the time axis; one shuffle by cell."""
    cell = Window.partitionBy("dataset_id", "variable", "z", "r", "c")
    leaf = df.withColumn("_x", visible_value())
    rows = leaf.withColumn("result", F.col("_x") - F.avg("_x").over(cell))
    return reclassify(rows.select("dataset_id", "variable", *CELL_KEY, "result"))
