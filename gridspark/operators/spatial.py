"""Nearest-point joins and regridding.

A nearest join here never compares all pairs, and its work follows the queries.  Points are
counted once in a pyramid of cells, each level twice as wide as the one below.  For the cells that hold queries, and
for no others, the pyramid tells the finest level at which the cell and its neighbours hold ``k``
points; two levels up the same place's block surely holds the ``k`` nearest, because its border is farther
away than any of those points.  The points of that block are the query's short candidate list.

Blocks that hold too many places, e.g. of queries that see a dense line from afar, are split: smaller
cells of queries keep the smaller cells of points that can hold one of their nearest.  Queries whose
finest cell still sees too many are searched one by one against ever smaller point cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from math import ceil, floor, isqrt, log2, pi, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ieee import INF, NAN, is_finite
from ..functions.scalars import norm_lon, to_degrees
from ..model import FINITE, GridError
from ..model import NAN as NAN_CLASS
from .joins import cut_lineage, lookup_join

#: Places a block may have as candidates; fuller blocks are split (copies of a point are one place).
BLOCK_PLACES = 4096
#: Places that may be left of a query that is searched by itself.
CANDIDATES = 256
#: Query cells with the keys of their blocks that may be broadcast.
HOMES = 100_000
_MAX_ROUNDS = 24


@dataclass(frozen=True)
class Space:
    """A cubic root cell, the domain of the queries, the area that points lie on and how cells are split in a search."""

    dims: int
    origin: float
    size: float
    low: tuple[float, ...]
    high: tuple[float, ...]
    area: float
    first_split: int
    split: int


# Root cells: degrees with room for the copies at +-360, and the unit cube.
DEGREES = Space(2, -1024.0, 2048.0, (-90.0, -180.0), (90.0, 180.0), 180.0 * 1080.0, 32, 4)
SPHERE = Space(3, -2.0, 4.0, (-1.0, -1.0, -1.0), (1.0, 1.0, 1.0), 4 * pi, 8, 2)


def _index(x: Column, space: Space, h: float) -> Column:
    return F.floor((x - space.origin) / h)


def _axes(space: Space, prefix: str) -> list[str]:
    return [f"{prefix}{a}" for a in range(space.dims)]


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join by sorting.

    The cells here come from explodes, or hold lists, which sizes before the explode or after compression
    do not tell; a broadcast chosen by these overfills the driver.
    """
    return left.join(right.hint("merge"), on, how)


def _counted(points: DataFrame, space: Space, h: float) -> DataFrame:
    """Non-empty point cells of width h, the points (with copies) and the places they hold."""
    ps = _axes(space, "p")
    return points.groupBy(*[_index(F.col(f"x{a}"), space, h).alias(p) for a, p in enumerate(ps)]).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("places")
    )


def _children(live: DataFrame, cells: DataFrame, space: Space, f: int) -> DataFrame:
    """Replace the point cells of ``live`` by their non-empty children."""
    ps = _axes(space, "p")
    parents = cells.select(*[F.floor(F.col(p) / f).alias(f"_{p}") for p in ps], *ps, "n", "places")
    return live.withColumnsRenamed({p: f"_{p}" for p in ps}).join(parents, [f"_{p}" for p in ps]).drop(
        *[f"_{p}" for p in ps]
    )


def _prune(pairs: DataFrame, by: list[str], near: Column, far: Column, k: int, few: int) -> DataFrame:
    """Keep the cells that can hold one of the k nearest; ``_done`` when at most ``few`` places are left.

    The k-th upper bound over the cells of a group limits the lower bounds of all.
    """
    group = Window.partitionBy(*by)
    pairs = pairs.withColumn("_near", near).withColumn("_far", far)
    pairs = pairs.withColumn("_held", F.sum("n").over(group.orderBy("_far")))
    pairs = pairs.withColumn("_bound", F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(group))
    # a little slack covers rounding of cell borders
    kept = pairs.filter(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound") * (1 + 1e-9) + 1e-15))
    return kept.withColumn("_done", F.sum("places").over(group) <= few)


def _depth(places: int, space: Space) -> int:
    """Levels of a pyramid whose finest cells are a quarter as wide as evenly spread points lie apart."""
    return max(1, min(40, ceil(log2(space.size / sqrt(space.area / max(places, 1)) * 4))))


def _levels(cells: DataFrame, names: list[str], depth: int, keep: list[str] | None = None) -> DataFrame:
    """(level, names, kept columns): each finest cell and all cells above it."""
    up = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), *[F.shiftright(c, i).alias(c) for c in names]) for i in range(depth + 1)]))
    return cells.select(up.alias("_up"), *(keep or [])).select("_up.*", *(keep or []))


def _around(cells: DataFrame, names: list[str], to: list[str]) -> DataFrame:
    """Each cell with itself and its neighbours, as columns ``to``."""
    steps = F.array(*[F.struct(*[(F.col(c) + d).alias(t) for c, t, d in zip(names, to, shift)]) for shift in product((-1, 0, 1), repeat=len(names))])
    return cells.withColumn("_near", F.explode(steps)).select(*cells.columns, "_near.*")


def _pyramid(points: DataFrame, space: Space, depth: int) -> DataFrame:
    """(level, p0.., n, places): all cells that hold points, from the finest up."""
    ps = _axes(space, "p")
    finest = _counted(points, space, space.size / 2**depth)
    cells = _levels(finest, ps, depth, ["n", "places"]).groupBy("level", *ps).agg(F.sum("n").alias("n"), F.sum("places").alias("places"))
    return cut_lineage(cells)


def homes(asked: DataFrame, points: DataFrame, space: Space, k: int, pyramid: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(homes, blocks, depth): the block of each finest cell that holds queries.

    ``asked`` has the finest cells q0.. of the queries.  ``homes`` gives their ``level`` and, as
    h0.., the cell at its centre; ``blocks`` lists the non-empty cells p0.. of each block with the ``places`` of the whole block.
    """
    qs, ps, hs = _axes(space, "q"), _axes(space, "p"), _axes(space, "h")
    depth = _depth(points.count(), space)
    pyramid = _pyramid(points, space, depth) if pyramid is None else pyramid
    above = _levels(asked, qs, depth)
    full = _met(_around(above.distinct(), qs, ps), pyramid, ["level", *ps]).groupBy("level", *qs).agg(F.sum("n").alias("n"))
    full = full.filter(F.col("n") >= k).select("level", *qs)
    own = [F.col(q).alias(f"own_{q}") for q in qs]
    own_above = _levels(asked.select(*qs, *own), qs, depth, [f"own_{q}" for q in qs])
    # where fewer than k points exist, all of them are candidates
    level = F.least(F.coalesce(F.min("fit"), F.lit(depth)) + 2, F.lit(depth))
    found = _met(own_above, full.withColumn("fit", F.col("level")), ["level", *qs], "left").groupBy(*[f"own_{q}" for q in qs]).agg(level.alias("level"))
    found = found.withColumnsRenamed({f"own_{q}": q for q in qs})
    found = cut_lineage(found.withColumns({h: F.expr(f"shiftright({q}, level)") for h, q in zip(hs, qs)}))
    inside = _met(_around(found.select("level", *hs).distinct(), hs, ps), pyramid, ["level", *ps])
    total = inside.groupBy("level", *hs).agg(F.sum("places").alias("total"))
    blocks = cut_lineage(_met(inside.select("level", *hs, *ps), total, ["level", *hs]))
    return found, blocks, depth


def _split_blocks(asked: DataFrame, blocks: DataFrame, pyramid: DataFrame, space: Space, depth: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(homes, blocks, rest): crowded blocks split until each has at most BLOCK_PLACES places.

    ``asked`` has the finest query cells q0.. with their ``level`` and home h0..; ``blocks`` the cells p0.. of
    these homes.  Each round halves query and point cells and keeps the point cells that can hold one of the k nearest
    of any place of the query cell.  ``rest`` lists the finest query cells whose block stays crowded.
    """
    qs, ps, hs = _axes(space, "q"), _axes(space, "p"), _axes(space, "h")
    front, found, kept_blocks = blocks.select("level", *hs, *ps), [], []
    rest = asked.filter("level = 0").select(*qs)
    asked = asked.filter("level > 0").select(*qs, "level")
    p_cells = pyramid.select("level", *ps, "n", "places", *[F.shiftright(p, 1).alias(f"_{p}") for p in ps])
    while not asked.isEmpty():
        asked = asked.select(*qs, (F.col("level") - 1).alias("level"))
        asked = asked.withColumns({h: F.expr(f"shiftright({q}, level)") for h, q in zip(hs, qs)})
        q_cells = asked.select("level", *hs, *[F.shiftright(h, 1).alias(f"_{h}") for h in hs]).distinct()
        above = front.select((F.col("level") - 1).alias("level"), *[F.col(c).alias(f"_{c}") for c in (*hs, *ps)])
        pairs = _met(_met(above, q_cells, ["level", *[f"_{h}" for h in hs]]), p_cells, ["level", *[f"_{p}" for p in ps]])
        w = F.pow(F.lit(2.0), F.col("level")) * (space.size / 2**depth)
        near, far = F.lit(0.0), F.lit(0.0)
        for h, p in zip(hs, ps):
            apart = F.abs(F.col(h) - F.col(p))
            gap, reach = F.greatest(apart - 1, F.lit(0)) * w, (apart + 1) * w
            near, far = near + gap * gap, far + reach * reach
        kept = cut_lineage(_prune(pairs, ["level", *hs], near, far, k, BLOCK_PLACES).select("level", *hs, *ps, "_done"))
        done = kept.filter("_done").select("level", *hs, *ps)
        settled = done.select("level", *hs).distinct()
        kept_blocks.append(done)
        found.append(asked.join(settled, ["level", *hs], "left_semi").select(*qs, "level", *hs))
        open_ = cut_lineage(asked.join(settled, ["level", *hs], "left_anti").select(*qs, "level"))
        rest = rest.unionByName(open_.filter("level = 0").select(*qs))
        asked, front = open_.filter("level > 0"), kept.filter("NOT _done").drop("_done")
    empty = blocks.limit(0)
    homes_ = reduce(DataFrame.unionByName, found) if found else empty.select(*[F.col(h).alias(q) for h, q in zip(hs, qs)], "level", *hs)
    return homes_, reduce(DataFrame.unionByName, kept_blocks, empty.select("level", *hs, *ps)), rest


def _block_lists(points: DataFrame, blocks: DataFrame, space: Space, depth: int, payload: list[str]) -> DataFrame:
    """The points of each block (level, h0..)."""
    ps, hs = _axes(space, "p"), _axes(space, "h")
    xs = [f"x{a}" for a in range(space.dims)]
    levels = [r["level"] for r in blocks.select("level").distinct().collect()]  # at most one per level of the pyramid
    h = space.size / 2**depth
    fine = points.select(*xs, "n", *payload, *[_index(F.col(x), space, h).alias(p) for x, p in zip(xs, ps)])
    cells = F.array(*[F.struct(F.lit(i).alias("level"), *[F.shiftright(p, i).alias(p) for p in ps]) for i in levels])
    placed = fine.withColumn("_cell", F.explode(cells)).select("_cell.*", *xs, "n", *payload)
    return _met(blocks, placed, ["level", *ps]).groupBy("level", *hs).agg(F.collect_list(F.struct(*xs, "n", *payload)).alias("_cands"))


def _search_each(queries: DataFrame, points: DataFrame, space: Space, payload: list[str], k: int) -> DataFrame:
    """Candidates of queries one by one, against point cells that are split from the root on.

    Such queries see many points at nearly the same distance, e.g. a dense cluster from
    afar.  Cells are measured from the exact place of each query, so few cells per query survive a round.
    """
    ps = _axes(space, "p")
    xs = [f"x{a}" for a in range(space.dims)]
    asked = cut_lineage(queries.withColumn("_qid", F.monotonically_increasing_id()))
    front = asked.select("_qid", *xs, *[F.lit(0).cast("long").alias(p) for p in ps])
    found, h = [], space.size
    for turn in range(_MAX_ROUNDS):
        f = space.first_split if turn == 0 else space.split
        h = h / f
        pairs = _children(front, _counted(points, space, h), space, f)
        near, far = F.lit(0.0), F.lit(0.0)
        for x, p in zip(xs, ps):
            lo = space.origin + F.col(p) * h
            hi = lo + h
            a = F.greatest(lo - F.col(x), F.col(x) - hi, F.lit(0.0))
            b = F.greatest(F.abs(F.col(x) - lo), F.abs(F.col(x) - hi))
            near, far = near + a * a, far + b * b
        kept = cut_lineage(_prune(pairs, ["_qid"], near, far, k, CANDIDATES).select("_qid", *xs, *ps, "_done"))
        last = turn == _MAX_ROUNDS - 1
        done = kept.select("_qid", *ps) if last else kept.filter("_done").select("_qid", *ps)
        placed = points.select(*xs, "n", *payload, *[_index(F.col(x), space, h).alias(p) for x, p in zip(xs, ps)])
        found.append(done.join(placed, ps).groupBy("_qid").agg(F.collect_list(F.struct(*xs, "n", *payload)).alias("_cands")))
        front = kept.filter(~F.col("_done")).drop("_done")
        if last or front.isEmpty():
            break
    return asked.join(reduce(DataFrame.unionByName, found), "_qid").drop("_qid")


def with_candidates(queries: DataFrame, points: DataFrame, space: Space, payload: list[str], k: int = 1) -> DataFrame:
    """Add ``_cands``: the points that can be among the k nearest of each query (NULL if there are none).

    ``queries`` has x0.. (NULL when unusable); ``points`` has x0.., n and ``payload``.
    """
    qs, ps, hs = _axes(space, "q"), _axes(space, "p"), _axes(space, "h")
    xs = [f"x{a}" for a in range(space.dims)]
    kind = "array<struct<" + ",".join(f"{f.name}: {f.dataType.simpleString()}" for f in points.select(*xs, "n", *payload).schema) + ">>"
    if points.isEmpty():
        return queries.withColumn("_cands", F.lit(None).cast(kind))
    usable = F.lit(True)
    for x, low, high in zip(xs, space.low, space.high):
        # the margin admits rounding of unit vectors
        usable = usable & F.coalesce(F.col(x).between(low - 1e-9, high + 1e-9), F.lit(False))
    depth = _depth(points.count(), space)
    h = space.size / 2**depth
    placed = queries.withColumns({q: F.when(usable, _index(F.col(x), space, h)) for q, x in zip(qs, xs)})
    pyramid = _pyramid(points, space, depth)
    found, blocks, _ = homes(placed.filter(usable).select(*qs).distinct(), points, space, k, pyramid)
    key = ["level", *hs]
    crowded = blocks.filter(F.col("total") > BLOCK_PLACES).select(*key, *ps)
    blocks = blocks.filter(F.col("total") <= BLOCK_PLACES).select(*key, *ps)
    rest = None
    if not crowded.isEmpty():
        dense = crowded.select(*key).distinct()
        more, parts, rest = _split_blocks(cut_lineage(found.join(dense, key, "left_semi").select(*qs, *key)), crowded, pyramid, space, depth, k)
        found = cut_lineage(found.join(dense, key, "left_anti").select(*qs, *key).unionByName(more))
        blocks = blocks.unionByName(parts)
    lists = _block_lists(points, blocks, space, depth, payload)
    # only the keys of a list travel with the queries; a list is shuffled once, with its block, and never broadcast
    if rest is None or rest.isEmpty():
        return lookup_join(placed, found, qs, max_rows=HOMES).drop(*qs).transform(_met, lists, key, "left").drop(*key)
    rest = cut_lineage(rest)
    easy = placed.join(rest, qs, "left_anti")
    easy = lookup_join(easy, found, qs, max_rows=HOMES).drop(*qs).transform(_met, lists, key, "left").drop(*key)
    hard = placed.join(rest, qs, "left_semi").drop(*qs)
    return easy.unionByName(_search_each(hard, points, space, payload, k))


def _dist2(c: Column, space: Space) -> Column:
    total = None
    for a in range(space.dims):
        d = c[f"x{a}"] - F.col(f"x{a}")
        total = d * d if total is None else total + d * d
    return total


def nearest_cell(queries: DataFrame, coord2d: DataFrame) -> DataFrame:
    """Nearest source cell of each query in plain latitude/longitude degrees.

    ``queries``: lat, lon and anything else; ``coord2d``: r, c, lat, lon.  Each source
    also counts at +-360 degrees; ties go to the lowest (row, column); non-finite sources
    are skipped.  Adds ``src_r``, ``src_c`` and ``d2``.
    """
    sources = coord2d.filter(is_finite(F.col("lat")) & is_finite(F.col("lon")))
    lon = norm_lon(F.col("lon"))
    points = cut_lineage(
        sources.select(
            F.col("lat").alias("x0"), F.explode(F.array(lon, lon - 360.0, lon + 360.0)).alias("x1"),
            F.struct("r", "c").alias("cell"),
        ).groupBy("x0", "x1").agg(F.min("cell").alias("cell"), F.lit(1).cast("long").alias("n"))
    )
    asked = queries.withColumn("x0", F.col("lat")).withColumn("x1", norm_lon(F.col("lon")))
    hit = with_candidates(asked, points, DEGREES, ["cell"])
    best = F.array_min(F.transform("_cands", lambda p: F.struct(_dist2(p, DEGREES).alias("d2"), p["cell"].alias("cell"))))
    return hit.withColumn("_best", best).select(
        *queries.columns, F.col("_best.cell.r").alias("src_r"), F.col("_best.cell.c").alias("src_c"),
        F.col("_best.d2").alias("d2"),
    )


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


def _mesh_points(mesh: DataFrame) -> DataFrame:
    """Distinct places of a mesh with lowest index and multiplicity."""
    usable = mesh.filter(is_finite(F.col("lat")) & is_finite(F.col("lon")))
    x = unit_vector(F.col("lat"), F.col("lon"))
    return usable.select(*[v.alias(f"x{i}") for i, v in enumerate(x)], "m").groupBy("x0", "x1", "x2").agg(
        F.min("m").alias("m"), F.count(F.lit(1)).alias("n")
    )


def mesh_reach(mesh: DataFrame, neighbours: int = 4) -> DataFrame:
    """One row ``reach2``: the largest squared distance of a point to its 4th nearest.

    The point itself counts; with fewer points the farthest one is taken, and a single
    point reaches everywhere.
    """
    points = cut_lineage(_mesh_points(mesh))
    total = points.agg(F.sum("n").alias("n")).first()["n"] or 0
    if total <= 1:
        return points.sparkSession.range(1).select(F.lit(INF).alias("reach2"))
    k = min(total, neighbours)
    hit = with_candidates(points.select("x0", "x1", "x2"), points.select("x0", "x1", "x2", "n"), SPHERE, [], k)
    by_distance = F.array_sort(F.transform("_cands", lambda p: F.struct(_dist2(p, SPHERE).alias("d2"), p["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("d2"))
    kth = F.aggregate(
        by_distance, start,
        lambda acc, p: F.struct(
            (acc["seen"] + p["n"]).alias("seen"), F.when(acc["seen"] < k, p["d2"]).otherwise(acc["d2"]).alias("d2")
        ),
        lambda acc: acc["d2"],
    )
    return hit.agg(F.max(kth).alias("reach2"))


def nearest_mesh(queries: DataFrame, mesh: DataFrame, reach2: float | None = None) -> DataFrame:
    """Nearest mesh point of each query by chord distance on the unit sphere.

    Adds ``m`` (lowest index on ties; NULL beyond ``reach2``) and ``d2``.
    """
    points = cut_lineage(_mesh_points(mesh))
    x = unit_vector(F.col("lat"), F.col("lon"))
    asked = queries
    for i, v in enumerate(x):
        asked = asked.withColumn(f"x{i}", v)
    hit = with_candidates(asked, points, SPHERE, ["m"])
    best = F.array_min(F.transform("_cands", lambda p: F.struct(_dist2(p, SPHERE).alias("d2"), p["m"].alias("m"))))
    out = hit.withColumn("_best", best)
    m = F.col("_best.m")
    if reach2 is not None:
        m = F.when(F.col("_best.d2") <= reach2, m)
    return out.select(*queries.columns, m.alias("m"), F.col("_best.d2").alias("d2"))


def grid_shape(step: float) -> tuple[int, int]:
    """Rows and columns of the regular grid with spacing ``step`` degrees."""
    if not 0 < step <= 90:
        raise GridError("grid spacing must be in (0, 90] degrees")
    return int(180.0 / step + 0.5), int(360.0 / step + 0.5)


def regular_grid(
    spark: SparkSession, step: float, window: tuple[int, int, int, int] | None = None, factor: int = 1
) -> DataFrame:
    """Cell centres of the regular grid (or a window of it, refined ``factor`` times).

    r and c count from the start of the window; centres are clipped at 90 and 180.
    """
    rows, cols = grid_shape(step)
    r0, r1, c0, c1 = window or (0, rows, 0, cols)
    if not (0 <= r0 < r1 <= rows and 0 <= c0 < c1 <= cols):
        raise GridError("requested window exceeds the regular grid")
    fine = step / factor
    n_r, n_c = (r1 - r0) * factor, (c1 - c0) * factor
    i = spark.range(n_r * n_c)
    r, c = F.floor(F.col("id") / n_c).cast("int"), (F.col("id") % n_c).cast("int")
    return i.select(
        r.alias("r"), c.alias("c"),
        F.least(-90.0 + (r + (r0 * factor + 0.5)) * fine, F.lit(90.0)).alias("lat"),
        F.least(-180.0 + (c + (c0 * factor + 0.5)) * fine, F.lit(180.0)).alias("lon"),
    )


def refinement(window_cells: int, global_cells: int, step: float) -> int:
    """Largest subdivision of a window that stays within the size of the global grid."""
    if window_cells == 0:
        return 1
    finest = floor(step / 0.01 + 1e-9)  # 0.01 degrees is the finest spacing
    return max(1, min(isqrt(global_cells // window_cells), finest))


def regrid_lookup(
    mesh: DataFrame, step: float = 0.25, window: tuple[int, int, int, int] | None = None, refine: bool = False
) -> DataFrame:
    """Nearest mesh index of every grid cell, NULL beyond the reach of the mesh."""
    factor = 1
    if refine and window is not None:
        rows, cols = grid_shape(step)
        factor = refinement((window[1] - window[0]) * (window[3] - window[2]), rows * cols, step)
    reach2 = mesh_reach(mesh).first()["reach2"]
    grid = regular_grid(mesh.sparkSession, step, window, factor)
    return nearest_mesh(grid, mesh, reach2).select("r", "c", "lat", "lon", "m")


def regrid(
    mesh_values: DataFrame, mesh: DataFrame, step: float = 0.25,
    window: tuple[int, int, int, int] | None = None, refine: bool = False,
) -> DataFrame:
    """Mesh values on a regular grid, for every variable, time and level at once.

    The lookup grid -> mesh is computed once per mesh and reused for all planes.  Cells
    out of reach, or with a non-finite value, have validity NaN.
    """
    lookup = regrid_lookup(mesh, step, window, refine)
    reached = lookup.filter("m IS NOT NULL")
    planes = mesh_values.select("dataset_id", "variable", "t", "z").distinct()
    values = mesh_values.select("dataset_id", "variable", "t", "z", "m", "raw")
    hits = reached.join(values, "m")
    # cells without a reading: each plane lists the whole grid
    holes = _fill_plane(planes, lookup)
    x = F.coalesce("raw", F.lit(NAN))
    full = holes.join(hits.drop("lat", "lon", "m"), ["dataset_id", "variable", "t", "z", "r", "c"], "left")
    return full.select(
        "dataset_id", "variable", "t", "z", "r", "c", "lat", "lon", x.alias("value"),
        F.when(is_finite(x), FINITE).otherwise(NAN_CLASS).alias("validity"),
    )


def _fill_plane(planes: DataFrame, lookup: DataFrame) -> DataFrame:
    """Every grid cell of every plane, row by row of the grid."""
    rows = lookup.groupBy("r").agg(
        F.min("lat").alias("lat"), F.sort_array(F.collect_list(F.struct("c", "lon"))).alias("_cols")
    )
    n_rows = rows.agg(F.max("r").alias("n")).scalar()
    key = ["dataset_id", "variable", "t", "z"]
    spread = planes.select(*key, F.explode(F.sequence(F.lit(0), n_rows)).alias("r")).repartition(*key, "r")
    return lookup_join(spread, rows, ["r"], "inner").withColumn("_c", F.explode("_cols")).select(
        "dataset_id", "variable", "t", "z", "r", "lat", F.col("_c.c").alias("c"), F.col("_c.lon").alias("lon")
    )


def projected_lookup(rows: int, cols: int, coord2d: DataFrame) -> DataFrame:
    """Source cell for every cell of a global rows x cols display grid."""
    spark = coord2d.sparkSession
    r, c = F.floor(F.col("id") / cols).cast("int"), (F.col("id") % cols).cast("int")
    grid = spark.range(rows * cols).select(
        r.alias("r"), c.alias("c"), (-90.0 + 180.0 * r / rows).alias("lat"), (-180.0 + 360.0 * c / cols).alias("lon")
    )
    return nearest_cell(grid, coord2d).select("r", "c", "src_r", "src_c")


def extent(coords: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Geographic extent of coordinates: finite limits, whole globe when undefined.

    A span of 350 degrees or more becomes the full circle in the axis's own convention.
    """
    def fin(name: str) -> Column:
        return F.when(is_finite(F.col(name)), F.col(name))

    rows = coords.groupBy(*(by or [])).agg(
        F.min(fin("lon")).alias("_a"), F.max(fin("lon")).alias("_b"),
        F.min(fin("lat")).alias("_c"), F.max(fin("lat")).alias("_d"),
    )
    a, b, c, d = (F.col(n) for n in ("_a", "_b", "_c", "_d"))
    eps = 2.220446049250313e-16
    usable = F.coalesce((F.abs(b - a) >= eps) & (F.abs(d - c) >= eps), F.lit(False))
    positive = (a >= -1e-6) & (b > 180.0 + 1e-6)
    full = (b - a) >= 350.0
    west = F.when(full, F.when(positive, 0.0).otherwise(-180.0)).otherwise(a)
    east = F.when(full, F.when(positive, 360.0).otherwise(180.0)).otherwise(b)
    return rows.select(
        *(by or []), F.when(usable, west).otherwise(-180.0).alias("min_lon"), F.when(usable, east).otherwise(180.0).alias("max_lon"),
        F.when(usable, c).otherwise(-90.0).alias("min_lat"), F.when(usable, d).otherwise(90.0).alias("max_lat"),
        (usable & positive).alias("zero_to_360"),
    )


def reorder_lon(df: DataFrame, coord2d: DataFrame) -> DataFrame:
    """Put columns in order of normalised longitude, moving values with coordinates.

    Applies to datasets on 0..360 or with rows that jump back at the date line; others
    keep their columns.  Only the coordinate table is ranked (one grid row per group);
    the cells follow by a join.
    """
    line = Window.partitionBy("dataset_id", "r").orderBy("c")
    ranked = Window.partitionBy("dataset_id", "r").orderBy("_lon", "c")
    rows = coord2d.withColumn("_lon", norm_lon(F.col("lon"))).withColumn(
        "_drop", F.col("lon") - F.lead("lon").over(line) > 180.0
    ).withColumn("_rank", F.row_number().over(ranked) - 1)
    facts = rows.groupBy("dataset_id").agg(
        F.coalesce(F.bool_or("_drop"), F.lit(False)).alias("_wraps"),
        F.min(F.when(is_finite(F.col("lon")), F.col("lon"))).alias("_lo"),
        F.max(F.when(is_finite(F.col("lon")), F.col("lon"))).alias("_hi"),
    ).select("dataset_id", (F.col("_wraps") | ((F.col("_lo") >= -1e-6) & (F.col("_hi") > 180.0 + 1e-6))).alias("_turn"))
    top = rows.filter("r = 0").select("dataset_id", "c", F.col("lon").alias("_lon0"), F.col("_rank").alias("_rank0"))
    rows = lookup_join(rows, top, ["dataset_id", "c"])
    # rows with the longitudes of the first one share its order
    same = F.bool_and(F.coalesce(F.abs(F.col("lon") - F.col("_lon0")) < 1e-6, F.lit(False))).over(
        Window.partitionBy("dataset_id", "r")
    )
    rows = lookup_join(rows.withColumn("_same", same), facts, ["dataset_id"])
    moved = F.when(F.col("_same"), F.col("_rank0")).otherwise(F.col("_rank"))
    table = rows.select(
        "dataset_id", "r", "c", F.when(F.col("_turn"), moved).otherwise(F.col("c")).cast("int").alias("new_c"),
        "lat", F.when(F.col("_turn"), F.col("_lon")).otherwise(F.col("lon")).alias("lon"),
    )
    return lookup_join(df, table, ["dataset_id", "r", "c"], "inner").drop("c").withColumnRenamed("new_c", "c")


def mesh(local: DataFrame | None, grid: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """Coordinates of a mesh, from the data itself or else from a separate grid dataset.

    Rows: dataset_id, m, lat, lon [, lat_units, lon_units]; angles without degree units
    are radians.  A length that differs from the values' mesh is an error.
    """
    if local is None and grid is None:
        raise GridError("mesh coordinates are not in the data; give a grid dataset")
    src = local if local is not None else grid
    if "lat_units" in src.columns:
        lat, lon = to_degrees(F.col("lat"), F.col("lat_units")), to_degrees(F.col("lon"), F.col("lon_units"))
    else:
        lat, lon = F.col("lat"), F.col("lon")
    out = src.select("dataset_id", "m", lat.alias("lat"), norm_lon(lon).alias("lon"))
    if values is not None:
        have = out.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_mesh"))
        need = values.groupBy("dataset_id").agg((F.max("m") + 1).alias("n_values"))
        bad = need.join(have, "dataset_id", "left").filter(~F.col("n_mesh").eqNullSafe(F.col("n_values"))).first()
        if bad is not None:
            raise GridError(
                f"mesh length mismatch in dataset {bad['dataset_id']}: "
                f"{bad['n_mesh']} coordinate values, {bad['n_values']} data values"
            )
    return out
