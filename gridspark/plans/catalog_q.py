"""Queries: axis roles, display axes, grid classes and variable search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from . import views as V
from .registry import query

# A catalogue with one file per ten parts; every part is one variable.  The words come
# from fixed lists so that each rule is hit.
NAMES = ["time", "lev", "lat", "lon", "Date", "hybrid_level", "row_nav", "x", "q2", "Height_agl"]
AXIS = ["T", " z", "Y", "X", "q"]
STANDARD = ["time", "ocean_sigma_coordinate", "Grid_Latitude", "longitude", "air_temperature"]
UNITS = ["degrees_east", "Degrees North", "hours since 2000-01-01", "degree_W", "K", "deg"]
DIMSETS = [
    ["time", "lev", "lat", "lon"], ["lat", "lon"], ["lon", "lat", "time"], ["nrow", "ncol"], ["time"],
    ["step", "height", "width"], ["kernel", "y", "x"], ["time", "empty", "lat", "lon"],
]


def sql_list(items) -> str:
    if isinstance(items[0], list):
        return "[" + ", ".join(sql_list(i) for i in items) + "]"
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def pick(items, index):
    def lit(i):
        return F.array(*[F.lit(x) for x in i]) if isinstance(i, list) else F.lit(i)

    return F.array(*[lit(i) for i in items])[index.cast("int")]


def variables(spark, sf):
    """Coordinate and data variables with their attributes."""
    k, size = F.col("p_partkey"), F.col("p_size")
    dims = pick(DIMSETS, k % 8)
    return V.table(spark, sf, "part").select(
        F.floor(k / 10).cast("int").alias("dataset_id"), (k % 10).cast("int").alias("pos"),
        F.concat(pick(NAMES, size % 10), F.when(size % 4 == 0, (k % 10).cast("string")).otherwise("")).alias("variable"),
        dims.alias("dims"), F.size(dims).alias("rank"), (size % 5 != 0).alias("is_number"),
        F.when(k % 6 == 0, pick(AXIS, size % 5)).alias("axis"), F.when(k % 9 == 0, pick(AXIS, k % 5)).alias("cartesian_axis"),
        F.when(k % 4 == 1, pick(STANDARD, size % 5)).alias("standard_name"),
        F.when(k % 3 == 1, pick(UNITS, size % 6)).alias("units"), F.when(k % 7 == 0, "up").alias("positive"),
    )


def dim_table(spark, sf):
    """Dimensions of every file: eleven names with lengths that vary by file."""
    names = sorted({d for s in DIMSETS for d in s})
    files = V.table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 10).cast("int").alias("dataset_id")).distinct()
    rows = files.select("dataset_id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("i", "dim"))
    length = F.when(F.col("dim") == "empty", F.col("dataset_id") % 2).otherwise((F.col("dataset_id") + F.col("i")) % 7 + 1)
    return rows.select(
        "dataset_id", "dim", length.cast("int").alias("length"),
        F.when(F.col("dataset_id") % 3 == 0, "other").otherwise(C.role_from_name(F.col("dim"))).alias("role"),
    )


VARS_SQL = f"""va AS (SELECT CAST(p_partkey // 10 AS INT) dataset_id, CAST(p_partkey % 10 AS INT) pos,
    concat({sql_list(NAMES)}[p_size % 10 + 1], CASE WHEN p_size % 4 = 0 THEN CAST(p_partkey % 10 AS VARCHAR) ELSE '' END) AS variable,
    {sql_list(DIMSETS)}[p_partkey % 8 + 1] AS dims, len({sql_list(DIMSETS)}[p_partkey % 8 + 1]) AS rank, p_size % 5 <> 0 AS is_number,
    CASE WHEN p_partkey % 6 = 0 THEN {sql_list(AXIS)}[p_size % 5 + 1] END AS axis, CASE WHEN p_partkey % 9 = 0 THEN {sql_list(AXIS)}[p_partkey % 5 + 1] END AS cartesian_axis,
    CASE WHEN p_partkey % 4 = 1 THEN {sql_list(STANDARD)}[p_size % 5 + 1] END AS standard_name,
    CASE WHEN p_partkey % 3 = 1 THEN {sql_list(UNITS)}[p_size % 6 + 1] END AS units, CASE WHEN p_partkey % 7 = 0 THEN 'up' END AS positive FROM part)"""


def name_role(x: str) -> str:
    return (
        f"CASE WHEN lower({x}) LIKE '%time%' THEN 'time' WHEN regexp_matches(lower({x}), 'depth|pressure|isobaric|height|altitude|hybrid') "
        f"OR lower({x}) IN ('lev','level','levels') THEN 'depth' WHEN lower({x}) IN ('date','dates') THEN 'time' "
        f"WHEN lower({x}) LIKE '%lat%' THEN 'latitude' WHEN lower({x}) LIKE '%lon%' THEN 'longitude' ELSE 'other' END"
    )


ROLE_SQL = f"""coalesce(
    CASE upper(left(trim(coalesce(axis, cartesian_axis)), 1)) WHEN 'T' THEN 'time' WHEN 'Z' THEN 'depth' WHEN 'Y' THEN 'latitude' WHEN 'X' THEN 'longitude' END,
    CASE lower(trim(standard_name)) WHEN 'time' THEN 'time' WHEN 'ocean_sigma_coordinate' THEN 'depth' WHEN 'grid_latitude' THEN 'latitude' WHEN 'longitude' THEN 'longitude' END,
    CASE units WHEN 'degrees_east' THEN 'longitude' WHEN 'degree_W' THEN 'longitude' WHEN 'Degrees North' THEN 'latitude' WHEN 'hours since 2000-01-01' THEN 'time' END,
    CASE WHEN positive IS NOT NULL AND rank = 1 THEN 'depth' END, {name_role('variable')})"""
ALL_DIMS = sorted({d for s in DIMSETS for d in s})
DIMS_SQL = f"""dm AS (SELECT dataset_id, dim, CAST(CASE WHEN dim = 'empty' THEN dataset_id % 2 ELSE (dataset_id + i) % 7 + 1 END AS INT) AS length,
      CASE WHEN dataset_id % 3 = 0 THEN 'other' ELSE {name_role('dim')} END AS role
    FROM (SELECT DISTINCT CAST(p_partkey // 10 AS INT) dataset_id FROM part), (SELECT unnest({sql_list(ALL_DIMS)}) dim, unnest(range(0, {len(ALL_DIMS)})) i))"""
# one row per variable and axis
AX_SQL = """ax AS (SELECT v.dataset_id, v.pos, v.rank, v.a - 1 AS a, v.dim, dm.length, dm.role FROM (
      SELECT dataset_id, pos, rank, unnest(range(1, rank+1)) a, dims[unnest(range(1, rank+1))] dim FROM va) v LEFT JOIN dm USING (dataset_id, dim))"""


@query("b1_axis_roles", f"WITH {VARS_SQL} SELECT dataset_id, pos, variable, {ROLE_SQL} AS role FROM va")
def _(spark, sf):
    return C.axis_roles(variables(spark, sf)).select("dataset_id", "pos", "variable", "role")


@query(
    "b2_name_roles",
    f"""WITH n AS (SELECT p_partkey, concat({sql_list(NAMES)}[p_size % 10 + 1], CASE WHEN p_partkey % 3 = 0 THEN '_pressure' ELSE '' END) nm FROM part)
        SELECT p_partkey, {name_role('nm')} AS netcdf4,
          CASE WHEN lower(nm) LIKE '%time%' OR lower(nm) IN ('date','dates') THEN 'time' WHEN regexp_matches(lower(nm), 'depth|lev') THEN 'depth'
               WHEN lower(nm) LIKE '%lat%' THEN 'latitude' WHEN lower(nm) LIKE '%lon%' THEN 'longitude' ELSE 'other' END AS netcdf3,
          CASE WHEN regexp_matches(lower(nm), 'lat|north') OR lower(nm)='y' THEN 'latitude' WHEN regexp_matches(lower(nm), 'lon|east') OR lower(nm)='x' THEN 'longitude'
               WHEN regexp_matches(lower(nm), 'time|step|grib') OR lower(nm)='t' THEN 'time' WHEN regexp_matches(lower(nm), 'depth|lev|height') OR lower(nm)='z' THEN 'depth' ELSE 'other' END AS manifest,
          CASE WHEN lower(nm) LIKE '%time%' OR lower(nm) IN ('date','dates') THEN 'time' WHEN regexp_matches(lower(nm), 'depth|lev|pressure|height|altitude') THEN 'depth' ELSE 'other' END AS mesh
        FROM n""",
)
def _(spark, sf):
    name = F.concat(pick(NAMES, F.col("p_size") % 10), F.when(F.col("p_partkey") % 3 == 0, "_pressure").otherwise(""))
    return V.table(spark, sf, "part").select(
        "p_partkey", *[C.role_from_name(name, p).alias(p) for p in ("netcdf4", "netcdf3", "manifest", "mesh")]
    )


@query(
    "b3_promote_roles",
    f"""WITH {VARS_SQL}, {DIMS_SQL}, k AS (SELECT dataset_id, pos, variable, dims[1] d, {ROLE_SQL} AS role FROM va WHERE rank = 1),
        u AS (SELECT dataset_id, d AS dim, min_by(role, pos) r FROM k WHERE role <> 'other' GROUP BY 1, 2)
        SELECT dataset_id, dim, length, CASE WHEN role = 'other' THEN coalesce(r, 'other') ELSE role END AS role FROM dm LEFT JOIN u USING (dataset_id, dim)
        UNION ALL SELECT dataset_id, variable, min_by(CAST(pos + 1 AS INT), pos), min_by(role, pos) FROM k WHERE role <> 'other'
          AND NOT EXISTS (SELECT 1 FROM dm WHERE dm.dataset_id = k.dataset_id AND dm.dim = k.variable) GROUP BY 1, 2""",
)
def _(spark, sf):
    coords = C.axis_roles(variables(spark, sf)).withColumn("length", (F.col("pos") + 1).cast("int"))
    return C.promote_roles(dim_table(spark, sf), coords)


@query(
    "b4_plottable",
    f"""WITH {VARS_SQL} SELECT dataset_id, pos, variable FROM va WHERE (is_number OR rank >= 2)
        AND NOT (rank >= 2 AND (axis IS NOT NULL OR cartesian_axis IS NOT NULL OR standard_name IS NOT NULL OR units IS NOT NULL) AND {ROLE_SQL} IN ('latitude','longitude'))""",
)
def _(spark, sf):
    return C.plottable(variables(spark, sf)).select("dataset_id", "pos", "variable")


@query(
    "b5_leading_axes",
    f"""WITH {VARS_SQL}, {DIMS_SQL}, {AX_SQL},
        rc AS (SELECT dataset_id, pos, coalesce(min(a) FILTER (role = 'latitude'), greatest(any_value(rank) - 2, 0)) rw, coalesce(min(a) FILTER (role = 'longitude'), greatest(any_value(rank) - 1, 0)) cl FROM ax GROUP BY 1, 2),
        s AS (SELECT ax.*, rw, cl, CASE WHEN role IN ('time','depth') THEN role WHEN a = 0 THEN 'time' WHEN a = 1 THEN 'depth' END eff FROM ax JOIN rc USING (dataset_id, pos)),
        g AS (SELECT dataset_id, pos, any_value(rw) rw, any_value(cl) cl, max(a) FILTER (eff='time' AND a<>rw AND a<>cl) ta, max(a) FILTER (eff='depth' AND a<>rw AND a<>cl) da FROM s GROUP BY 1, 2),
        l AS (SELECT g.*, (SELECT length FROM ax WHERE ax.dataset_id=g.dataset_id AND ax.pos=g.pos AND a=ta) nt, (SELECT length FROM ax WHERE ax.dataset_id=g.dataset_id AND ax.pos=g.pos AND a=da) nz FROM g)
        SELECT dataset_id, pos, CAST(ta AS INT) AS time_axis, CAST(da AS INT) AS depth_axis, CAST(rw AS INT) AS row_axis, CAST(cl AS INT) AS col_axis, coalesce(nt, 1) AS n_time, coalesce(nz, 1) AS n_depth FROM l""",
)
def _(spark, sf):
    rows = C.leading_axes(variables(spark, sf), dim_table(spark, sf))
    return rows.select("dataset_id", "pos", "time_axis", "depth_axis", "row_axis", "col_axis", "n_time", "n_depth")


@query(
    "b6_default_axes",
    f"""WITH {VARS_SQL}, {DIMS_SQL}, {AX_SQL},
        f AS (SELECT dataset_id, pos, min_by(dim, a) FILTER (role='longitude') rx, min_by(dim, a) FILTER (role='latitude') ry,
             min_by(dim, a) FILTER (regexp_matches(lower(dim), 'longitude|lon|width|column|cols')) wx, min_by(dim, a) FILTER (regexp_matches(lower(dim), 'latitude|lat|height|row|rows')) wy,
             list(dim ORDER BY a) FILTER (NOT regexp_matches(lower(dim), 'time|date|depth|level')) e, list(dim ORDER BY a) al FROM ax GROUP BY 1, 2)
        SELECT dataset_id, pos, CASE WHEN rx IS NOT NULL AND ry IS NOT NULL THEN rx WHEN wx IS NOT NULL AND wy IS NOT NULL THEN wx ELSE coalesce(e[-1], al[-1], '') END AS x_dim,
          CASE WHEN rx IS NOT NULL AND ry IS NOT NULL THEN ry WHEN wx IS NOT NULL AND wy IS NOT NULL THEN wy ELSE coalesce(e[-2], al[-2], '') END AS y_dim FROM f""",
)
def _(spark, sf):
    return C.default_axes(variables(spark, sf), dim_table(spark, sf)).select("dataset_id", "pos", "x_dim", "y_dim")


@query(
    "b7_plane_axes",
    f"""WITH {VARS_SQL}, {DIMS_SQL}, {AX_SQL},
        f AS (SELECT dataset_id, pos, any_value(rank) rank, min(a) FILTER (lower(dim) IN ('row','rows','height','y')) tr, min(a) FILTER (lower(dim) IN ('column','columns','col','cols','width','x')) tc,
             list(a ORDER BY a) FILTER (length > 0 AND {name_role('dim')} NOT IN ('time','depth')) e, list(a ORDER BY a) FILTER (length > 0) ne, list(length ORDER BY a) ln FROM ax GROUP BY 1, 2),
        p AS (SELECT *, CASE WHEN len(e) >= 2 THEN e ELSE ne END fr, tr IS NOT NULL AND tc IS NOT NULL AND tr <> tc AND ln[tr+1] > 0 AND ln[tc+1] > 0 ok FROM f)
        SELECT dataset_id, pos, CAST(CASE WHEN rank < 2 THEN NULL WHEN ok THEN tr WHEN len(fr) >= 2 THEN fr[-2] END AS INT) AS plane_row,
          CAST(CASE WHEN rank < 2 THEN NULL WHEN ok THEN tc WHEN len(fr) >= 2 THEN fr[-1] END AS INT) AS plane_col FROM p""",
)
def _(spark, sf):
    return C.plane_axes(variables(spark, sf), dim_table(spark, sf)).select("dataset_id", "pos", "plane_row", "plane_col")


@query(
    "b8_coordinate_planes",
    f"""WITH {VARS_SQL}, c AS (SELECT dataset_id, pos, variable, dims FROM va WHERE rank >= 3),
        pl AS (SELECT dataset_id, min(variable) cv FROM va WHERE rank = 2 GROUP BY 1)
        SELECT c.dataset_id, c.pos, CAST(CASE WHEN list_contains(dims,'lat') AND list_contains(dims,'lon') AND cv IS NOT NULL THEN list_position(dims,'lon') - 1 END AS INT) AS coord_row,
          CAST(CASE WHEN list_contains(dims,'lat') AND list_contains(dims,'lon') AND cv IS NOT NULL THEN list_position(dims,'lat') - 1 END AS INT) AS coord_col,
          coalesce(list_contains(dims,'lat') AND list_contains(dims,'lon') AND cv IS NOT NULL AND list_position(dims,'lon') > list_position(dims,'lat'), false) AS transposed
        FROM c LEFT JOIN pl USING (dataset_id)""",
)
def _(spark, sf):
    rows = variables(spark, sf)
    # the named 2-D coordinate of each file runs (lon, lat)
    coords = rows.filter("rank = 2").groupBy("dataset_id").agg(F.min("variable").alias("variable")).select(
        "dataset_id", "variable", F.lit(2).alias("rank"), F.array(F.lit("lon"), F.lit("lat")).alias("dims"), F.lit("latitude").alias("role")
    )
    data = rows.filter("rank >= 3").select("dataset_id", "pos", F.concat("variable", F.lit("#"), "pos").alias("variable"), "dims")
    named = data.join(coords.select("dataset_id", F.col("variable").alias("_c")), "dataset_id", "left")
    named = named.withColumn("coordinates", F.array_compact(F.array(F.lit("nothing"), F.col("_c")))).drop("_c")
    return C.coord_plane(named, coords).select("dataset_id", "pos", "coord_row", "coord_col", "transposed")


@query(
    "b9_grid_class",
    """SELECT 1 AS dataset_id, CAST(10 AS INT) AS rows, n AS cols, CASE WHEN n = 1 THEN 'rectilinear' ELSE 'curvilinear' END AS grid_class FROM ncols
       UNION ALL SELECT 2, 10, n, 'rectilinear' FROM ncols""",
    ("ncols",),
)
def _(spark, sf):
    curved = V.coord2d(spark, sf)
    plain = curved.select(
        F.lit(2).alias("dataset_id"), "r", "c", (F.col("r") * 18.0).alias("lat"), (F.col("c") * 2.0).alias("lon")
    )
    return C.classify_grid(curved.unionByName(plain))


@query(
    "b11_variable_search",
    f"WITH {VARS_SQL} SELECT dataset_id, pos, variable FROM va WHERE regexp_matches(lower(variable), 'l.*v')",
)
def _(spark, sf):
    return C.search_variables(variables(spark, sf), "LV").select("dataset_id", "pos", "variable")


@query(
    "b12_collection_variables",
    f"""WITH {VARS_SQL} SELECT variable, dataset_id, pos, dims FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY dataset_id, pos) k FROM va WHERE is_number) WHERE k = 1""",
)
def _(spark, sf):
    rows = variables(spark, sf).select("dataset_id", "pos", "variable", "dims", F.col("is_number").alias("numeric"))
    return C.collection_variables(rows).drop("numeric")


@query(
    "b13_latitude_order",
    """WITH g AS (SELECT CAST(o_custkey // 10 AS INT) dataset_id, CAST(o_custkey % 10 AS INT) r, CAST(o_orderkey % 7 AS INT) c,
             max(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END) lat FROM orders GROUP BY 1,2,3),
       e AS (SELECT dataset_id, max(r) l FROM g GROUP BY 1),
       f AS (SELECT g.dataset_id, min_by(lat, c) FILTER (r = 0 AND lat IS NOT NULL) a, min_by(lat, c) FILTER (r = l AND lat IS NOT NULL) b FROM g JOIN e USING (dataset_id) WHERE l > 0 GROUP BY 1)
       SELECT e.dataset_id, coalesce(b > a, false) AS lat_ascending FROM e LEFT JOIN f USING (dataset_id)""",
)
def _(spark, sf):
    grid = V.table(spark, sf, "orders").groupBy(
        F.floor(F.col("o_custkey") / 10).cast("int").alias("dataset_id"), (F.col("o_custkey") % 10).cast("int").alias("r"),
        (F.col("o_orderkey") % 7).cast("int").alias("c"),
    ).agg(F.max(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))).alias("lat"))
    return C.lat_ascending(grid.withColumn("lat", F.coalesce("lat", F.lit(float("nan")))))


@query(
    "b14_plane_diagnostics",
    f"""WITH {VARS_SQL}, {DIMS_SQL}, {AX_SQL},
        s AS (SELECT dataset_id, pos, string_agg(concat(dim, '=', coalesce(CAST(length AS VARCHAR), '?')), ', ' ORDER BY a) sh, min_by(dim, a) FILTER (length = 0) em, any_value(rank) rank,
              bool_or(dim='lat') hl, bool_or(dim='lon') hx FROM ax GROUP BY 1, 2),
        m AS (SELECT dataset_id, va.variable, CASE WHEN em IS NOT NULL THEN concat(va.variable, ': no plane, ', em, ' has length 0')
             WHEN s.rank < 2 THEN concat(va.variable, ' (', sh, '): a plane takes two dimensions or more')
             WHEN NOT (hl AND hx) THEN concat(va.variable, ' (', sh, '): no plane over lat and lon, which are not two of its dimensions') END message
           FROM s JOIN va USING (dataset_id, pos))
        SELECT dataset_id, variable, message FROM m WHERE message IS NOT NULL""",
)
def _(spark, sf):
    return C.plane_diagnostics(variables(spark, sf), dim_table(spark, sf), ("lon", "lat"))
