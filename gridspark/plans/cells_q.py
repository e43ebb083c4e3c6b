"""Queries: decoding, masks, arithmetic, slices, derived variables, differences, reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ieee import ieee_div, ieee_log, ieee_log10, ieee_pow
from ..model import GridSet
from ..operators import decode as D
from ..operators import derive as E
from ..operators import diff as X
from ..operators import reduce as R
from ..operators import slicing as P
from . import views as V
from .registry import query

KEY = "dataset_id, variable, t, z, r, c"


# --- C: decoding and scalar work ----------------------------------------------------


@query("c1_decode", f"SELECT {KEY}, raw, value, validity FROM decoded", ("decoded",))
def _(spark, sf):
    return V.decoded(spark, sf)


@query(
    "c2_valid_range",
    f"""SELECT {KEY}, raw, raw AS value, CASE WHEN raw < 5 OR raw > 45 THEN 'InvalidRange' ELSE 'Finite' END AS validity
        FROM cells""",
    ("cells",),
)
def _(spark, sf):
    attrs = V.attrs(spark, sf).select("dataset_id", "variable").withColumn("valid_range", F.array(F.lit(5.0), F.lit(45.0)))
    return D.decode(V.cells(spark, sf), attrs)


@query(
    "c3_decode_manifest",
    f"""SELECT {KEY}, raw, CASE WHEN variable='qty' THEN raw*0.5e0+10e0 ELSE raw END AS value,
        CASE WHEN variable='qty' AND raw = 50 THEN 'Fill' ELSE 'Finite' END AS validity FROM cells""",
    ("cells",),
)
def _(spark, sf):
    return D.decode(V.cells(spark, sf), V.attrs(spark, sf), "manifest")


@query(
    "c4_decode_grib",
    f"""SELECT {KEY}, raw, raw AS value, CASE WHEN isnan(raw) THEN 'Missing' WHEN isinf(raw) THEN 'PosInf' ELSE 'Finite' END AS validity
        FROM (SELECT {KEY}, CASE WHEN raw = 50 THEN CAST('nan' AS DOUBLE) WHEN raw = 1 THEN CAST('inf' AS DOUBLE) ELSE raw END AS raw FROM cells)""",
    ("cells",),
)
def _(spark, sf):
    raw = F.col("raw")
    cells = V.cells(spark, sf).withColumn(
        "raw", F.when(raw == 50, float("nan")).when(raw == 1, float("inf")).otherwise(raw)
    )
    return D.decode(cells, V.attrs(spark, sf).select("dataset_id", "variable"), "grib")


@query("c5_finite_value", f"SELECT {KEY}, CASE WHEN validity='Finite' THEN value END AS v FROM decoded", ("decoded",))
def _(spark, sf):
    df = V.decoded(spark, sf)
    return df.select("dataset_id", "variable", "t", "z", "r", "c", D.finite_value().alias("v"))


@query(
    "c6_mask_range",
    f"""SELECT {KEY}, value, validity, validity='Finite' AND (value < 15 OR value > 30) AS filtered
        FROM decoded""",
    ("decoded",),
)
def _(spark, sf):
    return D.mask_range(V.decoded(spark, sf), 15.0, 30.0).drop("raw")


@query(
    "c7_normalise_longitude",
    "SELECT event_id, ((v + 180e0) - 360e0*floor((v + 180e0)/360e0)) - 180e0 AS lon "
    "FROM (SELECT event_id, CAST((event_id*37) % 1441 AS DOUBLE) - 720e0 AS v FROM events)",
)
def _(spark, sf):
    x = ((F.col("event_id") * 37) % 1441).cast("double") - 720.0
    return V.table(spark, sf, "events").select("event_id", S.norm_lon(x).alias("lon"))


@query(
    "c8_longitude_convention",
    """SELECT event_id,
         CASE WHEN v > 180 THEN 180e0 - ((180e0-v) - 360e0*floor((180e0-v)/360e0))
              WHEN v < -180 THEN ((v+180e0) - 360e0*floor((v+180e0)/360e0)) - 180e0 ELSE v END AS signed_lon,
         CASE WHEN v > 360 THEN CASE WHEN v - 360e0*floor(v/360e0) = 0 THEN 360e0 ELSE v - 360e0*floor(v/360e0) END
              WHEN v < 0 THEN v - 360e0*floor(v/360e0) ELSE v END AS positive_lon
       FROM (SELECT event_id, CAST((event_id*37) % 1441 AS DOUBLE) - 720e0 AS v FROM events)""",
)
def _(spark, sf):
    x = ((F.col("event_id") * 37) % 1441).cast("double") - 720.0
    return V.table(spark, sf, "events").select(
        "event_id", S.lon_convention(x, "signed").alias("signed_lon"), S.lon_convention(x, "positive").alias("positive_lon")
    )


@query(
    "c9_radians_to_degrees",
    "SELECT event_id, round(CASE WHEN event_type='click' THEN value/100e0 ELSE degrees(value/100e0) END, 6) AS deg FROM events",
)
def _(spark, sf):
    unit = F.when(F.col("event_type") == "click", "Degrees_east").otherwise("radian")
    return V.table(spark, sf, "events").select(
        "event_id", F.round(S.to_degrees(F.col("value") / 100.0, unit), 6).alias("deg")
    )


@query(
    "c10_decode_time",
    """SELECT o_orderkey, CASE o_orderkey % 5
         WHEN 0 THEN strftime(TIMESTAMP '2021-03-22 06:00:00' + o_orderkey * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ')
         WHEN 1 THEN strftime(TIMESTAMP '1995-01-01 00:00:00' + o_orderkey * INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ')
         WHEN 2 THEN strftime(TIMESTAMP '1970-01-01 12:30:15' + o_orderkey * INTERVAL 60 SECOND, '%Y-%m-%dT%H:%M:%SZ')
         WHEN 3 THEN concat('t=', CAST(o_orderkey AS VARCHAR), ' fortnights since 2000-01-01')
         ELSE concat('t=', CAST(o_orderkey AS VARCHAR)) END AS label FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey") % 5
    units = (
        F.when(k == 0, "hours since 2021-03-22 06:00:00").when(k == 1, "days since 1995-1-1")
        .when(k == 2, "minutes since 1970-01-01T12:30:15").when(k == 3, "fortnights since 2000-01-01")
    )
    return V.table(spark, sf, "orders").select(
        "o_orderkey", S.decode_time(F.col("o_orderkey").cast("double"), units).alias("label")
    )


@query(
    "c11_decode_xtime",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS label FROM events",
)
def _(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, "2024-13-01_00:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd_HH:mm:ss"))
    return V.table(spark, sf, "events").select("event_id", S.decode_xtime(text).alias("label"))


@query(
    "c12_level_label",
    """SELECT p_partkey, concat(p_name, ' ', regexp_replace(printf('%.6f', p_retailprice), '\\.?0+$', ''),
         CASE WHEN p_size % 3 = 0 THEN '' ELSE ' mbar' END, ' (index ', p_size, ' of 49)') AS label FROM part""",
)
def _(spark, sf):
    unit = F.when(F.col("p_size") % 3 == 0, "").otherwise("mbar")
    none = F.lit(None).cast("string")
    return V.table(spark, sf, "part").select(
        "p_partkey",
        S.level_label(F.col("p_name"), none, F.lit("lev"), F.col("p_retailprice"), unit, F.col("p_size"), F.lit(50)).alias("label"),
    )


@query(
    "c14_transpose",
    "SELECT dataset_id, variable, t, z, c AS r, r AS c, value, validity FROM decoded",
    ("decoded",),
)
def _(spark, sf):
    return D.transpose(V.decoded(spark, sf)).drop("raw")


@query(
    "c15_north_up",
    f"SELECT {KEY}, CAST(9 - r AS INT) AS display_row FROM cells",
    ("cells",),
)
def _(spark, sf):
    from ..operators.catalog import lat_ascending

    axes = V.axes(spark, sf).filter("dim = 'lat'").select("dataset_id", F.col("idx").alias("r"), F.lit(0).alias("c"), F.col("coord").alias("lat"))
    n_rows = axes.groupBy("dataset_id").agg((F.max("r") + 1).alias("rows"))
    return P.north_up(V.cells(spark, sf), lat_ascending(axes), n_rows).drop("raw")


@query(
    "c16_refined_samples",
    """SELECT event_id, CAST(event_id // 3 AS INT) AS cell, CAST((event_id // 3 - 5)*3 + 1 AS INT) AS centre FROM events""",
)
def _(spark, sf):
    cell = S.source_cell(F.col("event_id"), 3)
    return V.table(spark, sf, "events").select("event_id", cell.alias("cell"), S.centre_sample(cell, 5, 3).alias("centre"))


@query(
    "c17_arithmetic",
    """WITH p AS (SELECT dataset_id, t, z, r, c, max(CASE WHEN variable='price' THEN v END) a,
                        max(CASE WHEN variable='qty' THEN v END) b FROM fin GROUP BY ALL)
       SELECT dataset_id, t, z, r, c, a+b AS add_v, a-b AS sub_v, a*b AS mul_v,
         CASE WHEN b-20e0 = 0 THEN CASE WHEN a > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END ELSE a/(b-20e0) END AS div_v,
         round(pow(b, 2e0), 6) AS pow_v, -a AS neg_v FROM p""",
    ("fin",),
)
def _(spark, sf):
    leaf = V.decoded(spark, sf).withColumn("v", D.visible_value())
    p = leaf.groupBy("dataset_id", "t", "z", "r", "c").agg(
        F.max(F.when(F.col("variable") == "price", F.col("v"))).alias("a"),
        F.max(F.when(F.col("variable") == "qty", F.col("v"))).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return p.select(
        "dataset_id", "t", "z", "r", "c", (a + b).alias("add_v"), (a - b).alias("sub_v"), (a * b).alias("mul_v"),
        ieee_div(a, b - 20.0).alias("div_v"), F.round(ieee_pow(b, 2.0), 6).alias("pow_v"), (-a).alias("neg_v"),
    )


@query(
    "c18_functions",
    f"""SELECT {KEY},
          CASE WHEN v-20e0 < 0 THEN CAST('nan' AS DOUBLE) WHEN v-20e0 = 0 THEN CAST('-inf' AS DOUBLE) ELSE round(ln(v-20e0), 9) END AS log_v,
          CASE WHEN v-20e0 < 0 THEN CAST('nan' AS DOUBLE) WHEN v-20e0 = 0 THEN CAST('-inf' AS DOUBLE) ELSE round(log10(v-20e0), 9) END AS log10_v,
          CASE WHEN v-20e0 < 0 THEN CAST('nan' AS DOUBLE) ELSE round(sqrt(v-20e0), 9) END AS sqrt_v,
          round(sin(v), 9) AS sin_v, round(cos(v), 9) AS cos_v, round(tan(v), 6) AS tan_v, round(exp(v/100e0), 9) AS exp_v, abs(v-20e0) AS abs_v
        FROM (SELECT {KEY}, v / CASE WHEN variable = 'price' THEN 1000e0 ELSE 1e0 END AS v FROM fin)""",
    ("fin",),
)
def _(spark, sf):
    v = F.col("v")
    # prices are scaled down, so that exp stays in range
    scale = F.when(F.col("variable") == "price", 1000.0).otherwise(1.0)
    df = V.decoded(spark, sf).filter("validity = 'Finite'").withColumn("v", F.col("value") / scale)

    def r9(x):
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.round(x, 9))

    return df.select(
        *[F.col(k.strip()) for k in KEY.split(",")],
        r9(ieee_log(v - 20.0)).alias("log_v"), r9(ieee_log10(v - 20.0)).alias("log10_v"), r9(F.sqrt(v - 20.0)).alias("sqrt_v"),
        F.round(F.sin(v), 9).alias("sin_v"), F.round(F.cos(v), 9).alias("cos_v"), F.round(F.tan(v), 6).alias("tan_v"),
        F.round(F.exp(v / 100.0), 9).alias("exp_v"), F.abs(v - 20.0).alias("abs_v"),
    )


@query(
    "c19_reclassify",
    f"""SELECT {KEY}, CASE WHEN validity <> 'Finite' OR value < 15 THEN CAST('nan' AS DOUBLE) WHEN value > 30 THEN CAST('inf' AS DOUBLE) ELSE value END AS value,
        CASE WHEN validity <> 'Finite' THEN 'Missing' WHEN value < 15 THEN 'NaN' WHEN value > 30 THEN 'PosInf' ELSE 'Finite' END AS validity
        FROM decoded""",
    ("decoded",),
)
def _(spark, sf):
    v = D.visible_value()
    df = V.decoded(spark, sf).withColumn(
        "result", F.when(v < 15, float("nan")).when(v > 30, float("inf")).otherwise(v)
    )
    return D.reclassify(df).drop("raw")


@query(
    "c20_slug_compact",
    """SELECT p_partkey, trim(regexp_replace(replace(lower(concat(p_brand, ' 2.5µm (', p_type, ')')), '.', 'p'), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
         regexp_replace(printf('%.6f', p_retailprice/8e0), '\\.?0+$', '') AS compact FROM part""",
)
def _(spark, sf):
    text = F.concat("p_brand", F.lit(" 2.5µm ("), "p_type", F.lit(")"))
    return V.table(spark, sf, "part").select(
        "p_partkey", S.slug(text).alias("slug"), S.compact(F.col("p_retailprice") / 8.0).alias("compact")
    )


# --- D: slices ----------------------------------------------------------------------


@query(
    "d1_plane",
    f"SELECT {KEY}, value, validity FROM decoded WHERE dataset_id=2 AND variable='qty' AND t=3 AND z=1 AND r >= 2 AND r < 9 AND c >= 0 AND c < 2",
    ("decoded",),
)
def _(spark, sf):
    return P.plane(V.gridset(spark, sf), "qty", 3, 1, P.Bounds(2, 9, 0, 2), 2).drop("raw")


@query(
    "d2_plane_on_axes",
    "SELECT dataset_id, variable, t AS r, z AS c, value, validity FROM decoded WHERE dataset_id=1 AND variable='price' AND r=4 AND c=1",
    ("decoded",),
)
def _(spark, sf):
    rows = V.decoded(spark, sf).filter("dataset_id=1 AND variable='price'").drop("raw")
    return P.plane_on(rows, "t", "z", {"r": 4, "c": 1})


@query(
    "d3_extra_dimensions",
    """SELECT CAST(l_suppkey % 10 AS INT) r, CAST(l_partkey // 100 AS INT) c, max(l_quantity) raw FROM lineitem
       WHERE l_linenumber = 7 AND l_orderkey % 4 = 2 GROUP BY 1, 2""",
)
def _(spark, sf):
    line = V.table(spark, sf, "lineitem")
    extra = F.create_map(
        F.lit("kernel"), (F.col("l_linenumber") - 1).cast("int"), F.lit("retrieval"), (F.col("l_orderkey") % 4).cast("int")
    )
    rows = line.select(
        (F.col("l_suppkey") % 10).cast("int").alias("r"), F.floor(F.col("l_partkey") / 100).cast("int").alias("c"),
        F.col("l_quantity").alias("raw"), extra.alias("extra"),
    )
    # kernel 99 is clamped to the last index
    fixed = P.fix_extra(rows, {"kernel": 99, "retrieval": 2}, {"kernel": 7, "retrieval": 4})
    return fixed.groupBy("r", "c").agg(F.max("raw").alias("raw"))


@query(
    "d4_axis_index",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN p_size % 4 <= 1 THEN 0 WHEN l_linenumber < p_size % 4 THEN l_linenumber END AS INT) AS idx,
        l_partkey, l_suppkey, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def _(spark, sf):
    line, part = V.table(spark, sf, "lineitem"), V.table(spark, sf, "part")
    rows = line.join(part, line.l_partkey == part.p_partkey)
    idx = P.axis_index_column(F.col("l_linenumber"), F.col("p_size") % 4)
    return rows.select("l_orderkey", "l_linenumber", idx.cast("int").alias("idx"), "l_partkey", "l_suppkey", "l_shipdate")


@query(
    "d5_bbox_axis",
    "SELECT dataset_id, min(idx) AS first, max(idx) AS last FROM axes WHERE dim='lat' AND coord BETWEEN -40 AND 30 GROUP BY 1",
    ("axes",),
)
def _(spark, sf):
    axis = V.axes(spark, sf).filter("dim='lat'")
    return P.bbox_axis(axis, -40.0, 30.0, "latitude")


@query(
    "d6_bbox_longitude",
    "SELECT dataset_id, min(idx) AS first, max(idx) AS last FROM axes WHERE dim='lon' AND coord BETWEEN 260 AND 300 GROUP BY 1",
    ("axes",),
)
def _(spark, sf):
    axis = V.axes(spark, sf).filter("dim='lon'")
    return P.bbox_axis(axis, -100.0, -60.0, "longitude")


@query(
    "d7_index_box",
    f"SELECT {KEY}, value, validity FROM decoded WHERE dataset_id=3 AND variable='qty' AND r BETWEEN 2 AND 5 AND c BETWEEN 0 AND 1",
    ("decoded",),
)
def _(spark, sf):
    gs = V.gridset(spark, sf)
    bare = GridSet(cells=gs.cells, vars=gs.vars, dims=gs.dims)
    return P.bbox(bare, "qty", (0.0, 1.0), (2.0, 5.0), 3).drop("raw")


@query(
    "d8_bbox_curvilinear",
    """SELECT dataset_id, min(r) r0, max(r) r1, min(c) c0, max(c) c1, true AS approximate FROM coord2d
       WHERE lon BETWEEN -60 AND 45 AND lat BETWEEN -30 AND 20 GROUP BY 1""",
    ("coord2d",),
)
def _(spark, sf):
    return P.bbox_2d(V.coord2d(spark, sf), (-60.0, 45.0), (-30.0, 20.0))


@query(
    "d9_bbox_cells",
    f"""SELECT {KEY}, value, validity FROM decoded WHERE dataset_id=2 AND variable='qty'
        AND r IN (SELECT idx FROM axes WHERE dim='lat' AND coord BETWEEN -40 AND 30)
        AND c IN (SELECT idx FROM axes WHERE dim='lon' AND coord BETWEEN 0 AND 180)""",
    ("decoded", "axes"),
)
def _(spark, sf):
    return P.bbox(V.gridset(spark, sf), "qty", (0.0, 180.0), (-40.0, 30.0), 2).drop("raw")


@query(
    "d12_mesh_plane",
    "SELECT dataset_id, variable, t, z, m, raw FROM mesh_values WHERE t = 5 AND z = 0",
    ("mesh_values",),
)
def _(spark, sf):
    return P.mesh_plane(V.mesh_values(spark, sf), "value", t=5)


@query(
    "d13_point",
    f"""SELECT {KEY}, value, validity, r*18e0-81e0 AS lat,
          (lon + 180e0) - 360e0*floor((lon+180e0)/360e0) - 180e0 AS lon
        FROM (SELECT d.*, a.coord lon FROM decoded d JOIN axes a ON a.dataset_id=d.dataset_id AND a.dim='lon' AND a.idx=d.c
              WHERE d.dataset_id=1 AND d.variable='price' AND d.t=2 AND d.z=3 AND d.r=4 AND d.c=1)""",
    ("decoded", "axes"),
)
def _(spark, sf):
    gs = V.gridset(spark, sf)
    gs = GridSet(cells=gs.cells, vars=gs.vars, dims=gs.dims, axes=gs.axes)
    return P.point(gs, "price", 4, 1, 2, 3, 1).drop("raw")


# --- E: derived variables and differences -------------------------------------------

PAIR = """p AS (SELECT dataset_id, t, z, r, c, max(CASE WHEN variable='price' THEN v END) a,
                       max(CASE WHEN variable='qty' THEN v END) b FROM (
                  SELECT dataset_id, variable, t, z, r, c, CASE WHEN validity='Finite' THEN value END v FROM decoded) GROUP BY ALL)"""


def classified(expr: str) -> str:
    """SQL for value and validity of a formula result in which NULL is missing."""
    return (
        f"coalesce({expr}, CAST('nan' AS DOUBLE)) AS value, CASE WHEN {expr} IS NULL THEN 'Missing' "
        f"WHEN isnan({expr}) THEN 'NaN' WHEN isinf({expr}) THEN CASE WHEN {expr} > 0 THEN 'PosInf' ELSE 'NegInf' END ELSE 'Finite' END AS validity"
    )


@query(
    "e1_derive",
    f"WITH {PAIR} SELECT dataset_id, 'mix' AS variable, t, z, r, c, {classified('(a + b*2)')} FROM p",
    ("decoded",),
)
def _(spark, sf):
    return E.derive(V.gridset(spark, sf), "mix", [E.ref("price"), E.ref("qty")], lambda a, b: a + b * 2)


@query(
    "e2_derive_across",
    f"""WITH w AS (SELECT t, z, r, c, max(CASE WHEN dataset_id=2 THEN v END) a, max(CASE WHEN dataset_id=1 THEN v END) b
                  FROM (SELECT *, CASE WHEN validity='Finite' THEN value END v FROM decoded WHERE variable='qty' AND dataset_id IN (1,2)) GROUP BY ALL),
             q AS (SELECT *, CASE WHEN b - 20e0 = 0 THEN CASE WHEN a > 0 THEN CAST('inf' AS DOUBLE) WHEN a IS NULL THEN NULL ELSE CAST('nan' AS DOUBLE) END ELSE a/(b-20e0) END x FROM w)
        SELECT 2 AS dataset_id, 'ratio' AS variable, t, z, r, c, {classified('x')} FROM q""",
    ("decoded",),
)
def _(spark, sf):
    return E.derive(
        V.gridset(spark, sf), "ratio", [E.ref("qty", 2), E.ref("qty", 1)], lambda a, b: ieee_div(a, b - 20.0)
    )


@query(
    "e3_static_field",
    f"""SELECT d.dataset_id, 'per_area' AS variable, t, z, d.r, d.c, {classified('(v / a.raw)')}
        FROM (SELECT *, CASE WHEN validity='Finite' THEN value END v FROM decoded WHERE variable='qty') d JOIN area a ON d.r=a.r AND d.c=a.c""",
    ("decoded", "area"),
)
def _(spark, sf):
    gs = _with_area(spark, sf)
    return E.derive(gs, "per_area", [E.ref("qty"), E.ref("area")], lambda q, a: ieee_div(q, a))


def _with_area(spark, sf) -> GridSet:
    """The grid plus a static ``area`` variable in every dataset."""
    gs = V.gridset(spark, sf)
    area = V.area(spark, sf).select(
        F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("dataset_id"), F.lit("area").alias("variable"),
        F.lit(0).alias("t"), F.lit(0).alias("z"), "r", "c", "raw", F.col("raw").alias("value"), F.lit("Finite").alias("validity"),
    )
    names = gs.vars.filter("variable = 'qty'").select(
        "dataset_id", F.lit(2).alias("pos"), F.lit("area").alias("variable"),
        F.array(F.lit("lat"), F.lit("lon")).alias("dims"), F.lit(True).alias("numeric"),
        F.lit("m2").alias("units"), F.lit("Area").alias("long_name"), F.lit(None).cast("string").alias("standard_name"),
    )
    return GridSet(cells=gs.cells.unionByName(area), vars=gs.vars.unionByName(names), dims=gs.dims)


@query(
    "e4_shape_check",
    "SELECT dataset_id, false AS accepted, 'a reference is not a plottable variable' AS reason FROM vars GROUP BY 1",
    ("vars",),
)
def _(spark, sf):
    gs = V.gridset(spark, sf)
    return E.bind(gs, E.Derived("bad", (E.ref("qty"), E.ref("nosuch")), lambda a, b: a + b))


@query(
    "e5_derived_catalogue",
    """SELECT dataset_id, 'qmean' AS variable, ['lev','lat','lon'] AS dims, true AS "numeric", CAST(NULL AS VARCHAR) AS units,
         'time_mean(qty)' AS long_name, CAST(NULL AS VARCHAR) AS standard_name FROM vars GROUP BY 1""",
    ("vars",),
)
def _(spark, sf):
    d = E.Derived("qmean", (E.ref("qty"),), lambda a: a, ("time", "mean"), "time_mean(qty)")
    return E.derived_vars(V.gridset(spark, sf), d)


@query(
    "e6_apply_formulas",
    f"""WITH {PAIR}, w AS (SELECT t, z, r, c, max(CASE WHEN dataset_id=3 THEN v END) a, max(CASE WHEN dataset_id=1 THEN v END) b
             FROM (SELECT *, CASE WHEN validity='Finite' THEN value END v FROM decoded WHERE variable='qty' AND dataset_id IN (1,3)) GROUP BY ALL)
        SELECT dataset_id, 'total' AS variable, t, z, r, c, {classified('(a*b)')} FROM p
        UNION ALL SELECT 3, 'change', t, z, r, c, {classified('(a-b)')} FROM w""",
    ("decoded",),
)
def _(spark, sf):
    rows, _errors = E.apply_formulas(
        V.gridset(spark, sf),
        [
            E.Derived("total", (E.ref("price"), E.ref("qty")), lambda a, b: a * b),
            E.Derived("change", (E.ref("qty", 3), E.ref("qty", 1)), lambda a, b: a - b),
        ],
    )
    return rows


@query(
    "e7_formula_errors",
    "SELECT dataset_id, false AS accepted, 'qty is already a variable name' AS reason FROM vars GROUP BY 1",
    ("vars",),
)
def _(spark, sf):
    return E.bind(V.gridset(spark, sf), E.Derived("qty", (E.ref("price"),), lambda a: a))


@query(
    "e8_diff",
    """WITH s AS (SELECT variable, t, z, r, c, max(CASE WHEN dataset_id=1 AND validity='Finite' THEN value END) a,
                        max(CASE WHEN dataset_id=2 AND validity='Finite' THEN value END) b
                 FROM decoded WHERE dataset_id IN (1,2) GROUP BY ALL)
       SELECT variable, t, z, r, c, coalesce(a-b, CAST('nan' AS DOUBLE)) AS value,
              CASE WHEN a-b IS NULL THEN 'Missing' ELSE 'Finite' END AS validity FROM s""",
    ("decoded",),
)
def _(spark, sf):
    return X.diff(V.gridset(spark, sf), 1, 2)


@query(
    "e9_diff_sets",
    """WITH pairs(pair, a, b) AS (VALUES (1, 1, 3), (2, 2, 3)),
       s AS (SELECT pair, variable, t, z, r, c, max(CASE WHEN dataset_id=a AND validity='Finite' THEN value END) x,
                    max(CASE WHEN dataset_id=b AND validity='Finite' THEN value END) y
             FROM decoded JOIN pairs ON dataset_id IN (a, b) GROUP BY ALL)
       SELECT CAST(pair AS INT) AS pair, variable, t, z, r, c, coalesce(x-y, CAST('nan' AS DOUBLE)) AS value,
              CASE WHEN x-y IS NULL THEN 'Missing' ELSE 'Finite' END AS validity FROM s""",
    ("decoded",),
)
def _(spark, sf):
    gs = V.gridset(spark, sf)
    paths = gs.vars.select("dataset_id").distinct().withColumn("path", F.format_string("run_%d.nc", F.col("dataset_id")))
    return X.diff_sets(gs, paths.filter("dataset_id < 3"), paths.filter("dataset_id = 3"))


@query(
    "e10_coordinates",
    f"""SELECT d.dataset_id, d.variable, d.t, d.z, d.r, d.c, d.raw, y.coord AS lat,
          (x.coord + 180e0) - 360e0*floor((x.coord+180e0)/360e0) - 180e0 AS lon
        FROM cells d LEFT JOIN axes y ON y.dataset_id=d.dataset_id AND y.dim='lat' AND y.idx=d.r
        LEFT JOIN axes x ON x.dataset_id=d.dataset_id AND x.dim='lon' AND x.idx=d.c""",
    ("cells", "axes"),
)
def _(spark, sf):
    return P.with_coords(V.cells(spark, sf), GridSet(cells=None, axes=V.axes(spark, sf)))


@query(
    "e10_coordinates_2d",
    """SELECT d.dataset_id, d.variable, d.t, d.z, d.r, d.c, d.raw, k.lat, (k.lon + 180e0) - 360e0*floor((k.lon+180e0)/360e0) - 180e0 AS lon
       FROM cells d LEFT JOIN coord2d k ON k.dataset_id=d.dataset_id AND k.r=d.r AND k.c=d.c""",
    ("cells", "coord2d"),
)
def _(spark, sf):
    # dataset 1 has curvilinear coordinates, the others have none
    return P.with_coords(V.cells(spark, sf), GridSet(cells=None, coord2d=V.coord2d(spark, sf)))


@query(
    "e11_anomaly",
    f"""WITH l AS (SELECT {KEY}, CASE WHEN validity='Finite' THEN value END v FROM decoded),
        a AS (SELECT {KEY}, v - (sum(v) OVER w)/(count(v) OVER w) x FROM l WINDOW w AS (PARTITION BY dataset_id, variable, z, r, c))
        SELECT {KEY}, {classified('x')} FROM a""",
    ("decoded",),
)
def _(spark, sf):
    return E.anomaly(V.decoded(spark, sf))


# --- G: statistics and reductions ---------------------------------------------------


@query(
    "g1_plane_statistics",
    """SELECT dataset_id, variable, t, z, min(v) AS min, max(v) AS max, sum(v)/count(v) AS mean, count(v) AS finite_count
       FROM (SELECT *, CASE WHEN validity='Finite' THEN value END v FROM decoded) GROUP BY ALL""",
    ("decoded",),
)
def _(spark, sf):
    return R.stats(V.decoded(spark, sf))


def _reduction(name: str, axis: str, how: str):
    gone = "t" if axis == "time" else "z"
    keys = ", ".join(k for k in ("dataset_id", "variable", "t", "z", "r", "c") if k != gone)
    agg = "sum(v)/count(v)" if how == "mean" else f"{how}(v)"
    sql = f"""WITH l AS (SELECT {KEY}, CASE WHEN validity='Finite' THEN value END v FROM decoded),
              a AS (SELECT {keys}, {agg} AS x FROM l GROUP BY ALL) SELECT {keys}, {classified('x')} FROM a"""

    @query(name, sql, ("decoded",))
    def _(spark, sf):
        return R.reduce_axis(V.decoded(spark, sf), axis, how)


for _how in ("mean", "sum", "min", "max"):
    _reduction(f"g2_time_{_how}", "time", _how)
    _reduction(f"g2b_layer_{_how}", "layer", _how)


@query(
    "g2_time_min_nan_poison",
    f"""WITH l AS (SELECT {KEY}, CASE WHEN validity='Finite' THEN CASE WHEN value = 20 OR value % 7 = 3 AND variable = 'price' THEN CAST('nan' AS DOUBLE) ELSE value END END v FROM decoded),
        a AS (SELECT dataset_id, variable, z, r, c, CASE WHEN bool_or(isnan(v)) THEN CAST('nan' AS DOUBLE) ELSE min(v) END lo,
                     CASE WHEN bool_or(isnan(v)) THEN CAST('nan' AS DOUBLE) ELSE max(v) END hi FROM l GROUP BY ALL)
        SELECT * FROM a""",
    ("decoded",),
)
def _(spark, sf):
    v = D.visible_value()
    poison = (v == 20) | ((v % 7 == 3) & (F.col("variable") == "price"))
    df = V.decoded(spark, sf).withColumn("x", F.when(poison, float("nan")).otherwise(v))
    return df.groupBy("dataset_id", "variable", "z", "r", "c").agg(
        R.reducer("min", F.col("x")).alias("lo"), R.reducer("max", F.col("x")).alias("hi")
    )


@query(
    "g2c_nested_reduction",
    """WITH l AS (SELECT dataset_id, variable, t, z, r, c, CASE WHEN validity='Finite' THEN value END v FROM decoded),
       m AS (SELECT dataset_id, variable, t, r, c, max(v) x FROM l GROUP BY ALL),
       n AS (SELECT dataset_id, t, r, c, max(CASE WHEN variable='price' THEN x END) - max(CASE WHEN variable='qty' THEN x END) d FROM m GROUP BY ALL)
       SELECT dataset_id, r, c, sum(d)/count(d) AS mean_range FROM n GROUP BY ALL""",
    ("decoded",),
)
def _(spark, sf):
    # time_mean(layer_max(price) - layer_max(qty))
    tops = R.reduce_column(V.decoded(spark, sf).withColumn("x", D.visible_value()), "x", "layer", "max")
    wide = tops.groupBy("dataset_id", "t", "r", "c").agg(
        F.max(F.when(F.col("variable") == "price", F.col("x"))).alias("p"),
        F.max(F.when(F.col("variable") == "qty", F.col("x"))).alias("q"),
    )
    return R.reduce_column(wide.withColumn("mean_range", F.col("p") - F.col("q")), "mean_range", "time", "mean")
