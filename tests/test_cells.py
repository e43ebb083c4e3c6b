"""Decoding, IEEE arithmetic, labels, slices, formulas, reductions and differences."""

import math

import pytest
from pyspark.sql import functions as F

from gridspark.functions import scalars as S
from gridspark.functions.ieee import ieee_div, ieee_log, ieee_log10
from gridspark.model import ATTRS, CELLS, GridError, GridSet
from gridspark.operators import derive as E
from gridspark.operators import reduce as R
from gridspark.operators import slicing as P
from gridspark.operators.catalog import leading_axes
from gridspark.operators.decode import decode, finite_value, mask_range, reclassify, transpose
from gridspark.operators.diff import diff, pair_sets
from gridspark.operators.joins import lookup_join

NAN, INF = float("nan"), float("inf")


def plane_cells(spark, values, dataset=1, variable="x", cols=2, t=0, z=0):
    rows = [(dataset, variable, t, z, i // cols, i % cols, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, CELLS)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or (a != a and b != b)))


def test_packed_cells_follow_the_precedence(spark):
    cells = plane_cells(spark, [999, -1, 2, NAN, INF], cols=5)
    attrs = spark.createDataFrame([(1, "x", 999.0, None, 0.0, None, None, 2.0, 1.0)], ATTRS)
    rows = decode(cells, attrs).orderBy("c").collect()
    assert [r["validity"] for r in rows] == ["Fill", "InvalidRange", "Finite", "NaN", "PosInf"]
    assert rows[0]["value"] == 1999.0 and rows[2]["value"] == 5.0


def test_packed_classic_window(spark):
    cells = plane_cells(spark, [14, 16, -999, 22], cols=2, variable="temp")
    attrs = spark.createDataFrame([(1, "temp", -999.0, None, None, None, None, 0.5, 10.0)], ATTRS)
    rows = decode(cells, attrs).orderBy("r", "c").collect()
    assert [(r["value"], r["validity"]) for r in rows if r["validity"] != "Fill"] == [(17.0, "Finite"), (18.0, "Finite"), (21.0, "Finite")]
    assert rows[2]["validity"] == "Fill"


def test_nan_fill_and_valid_range_pair(spark):
    cells = plane_cells(spark, [NAN, 1, 9], cols=3)
    attrs = spark.createDataFrame([(1, "x", NAN, None, None, None, [0.0, 5.0], None, None)], ATTRS)
    assert [r["validity"] for r in decode(cells, attrs).orderBy("c").collect()] == ["Fill", "Finite", "InvalidRange"]


def test_explicit_limit_beats_the_pair(spark):
    cells = plane_cells(spark, [-3, 9], cols=2)
    attrs = spark.createDataFrame([(1, "x", None, None, -5.0, None, [0.0, 5.0], None, None)], ATTRS)
    assert [r["validity"] for r in decode(cells, attrs).orderBy("c").collect()] == ["Finite", "InvalidRange"]


def test_manifest_and_grib_profiles(spark):
    cells = plane_cells(spark, [5, 5 + 1e-10, 6, NAN, INF], cols=5)
    attrs = spark.createDataFrame([(1, "x", 5.0, None, None, None, None, None, None)], ATTRS)
    got = [r["validity"] for r in decode(cells, attrs, "manifest").orderBy("c").collect()]
    assert got == ["Fill", "Fill", "Finite", "Fill", "Fill"]
    got = [r["validity"] for r in decode(cells, attrs, "grib").orderBy("c").collect()]
    assert got == ["Finite", "Finite", "Finite", "Missing", "PosInf"]
    with pytest.raises(GridError):
        decode(cells, attrs, "other")


def test_statistics_of_finite_cells(spark):
    cells = spark.createDataFrame(
        [(1, "x", 0, 0, 0, 0, 1.0, 1.0, "Finite"), (1, "x", 0, 0, 0, 1, 2.0, 2.0, "Finite"),
         (1, "x", 0, 0, 1, 0, 9.0, 9.0, "Fill"), (1, "x", 0, 0, 1, 1, NAN, NAN, "NaN")],
        CELLS + ", value DOUBLE, validity STRING",
    )
    s = R.stats(cells).first()
    assert (s["min"], s["max"], s["mean"], s["finite_count"]) == (1.0, 2.0, 1.5, 2)
    assert cells.filter("r = 1").select(finite_value().alias("v")).filter("v IS NOT NULL").count() == 0
    with pytest.raises(GridError):
        mask_range(cells, 3.0, 1.0)
    flags = mask_range(cells, 0.0, 1.5).orderBy("r", "c").collect()
    assert [f["filtered"] for f in flags] == [False, True, False, False]


@pytest.mark.parametrize("a,b,want", [(1, 0, INF), (-1, 0, -INF), (1, -0.0, -INF), (0, 0, NAN), (6, 3, 2.0), (NAN, 0, NAN), (INF, INF, NAN)])
def test_division(spark, a, b, want):
    assert same(one(spark, ieee_div(F.lit(float(a)), F.lit(float(b)))), want)


@pytest.mark.parametrize("x,want", [(-9.0, NAN), (0.0, -INF), (INF, INF), (NAN, NAN), (1.0, 0.0)])
def test_logarithms(spark, x, want):
    assert same(one(spark, ieee_log(F.lit(x))), want)
    assert same(one(spark, ieee_log10(F.lit(x))), want)
    assert one(spark, ieee_log(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("x,signed,positive,norm", [
    (180, 180, 180, -180), (-180, -180, 180, -180), (540, 180, 180, -180), (-540, -180, 180, -180),
    (720, 0, 360, 0), (360, 0, 360, 0), (-90, -90, 270, -90), (0, 0, 0, 0), (190, -170, 190, -170),
])
def test_longitudes(spark, x, signed, positive, norm):
    c = F.lit(float(x))
    assert one(spark, S.lon_convention(c, "signed")) == signed
    assert one(spark, S.lon_convention(c, "positive")) == positive
    assert one(spark, S.norm_lon(c)) == norm
    assert math.isnan(one(spark, S.norm_lon(F.lit(NAN))))


@pytest.mark.parametrize("value,units,want", [
    (0.0, "hours since 2021-03-22 06:00:00", "2021-03-22T06:00:00Z"),  # the clock part counts
    (31.0, "days since 2000-01-01", "2000-02-01T00:00:00Z"),
    (-1.0, "days since 2000-01-01", "1999-12-31T00:00:00Z"),
    (90.0, "min since 2000-1-1 0:30", "2000-01-01T02:00:00Z"),
    (1.5, "months since 2000-01-01", "t=1.5 months since 2000-01-01"),
    (3.0, "days since yesterday", "t=3 days since yesterday"),
    (3.0, "K", "t=3 K"), (7.0, None, "t=7"),
])
def test_time_labels(spark, value, units, want):
    assert one(spark, S.decode_time(F.lit(value), F.lit(units).cast("string"))) == want


def test_foreign_calendar_is_refused(spark):
    units = F.lit("days since 2000-01-01")
    assert one(spark, S.decode_time(F.lit(1.0), units, F.lit("standard"))) == "2000-01-02T00:00:00Z"
    with pytest.raises(Exception, match="unsupported calendar"):
        one(spark, S.decode_time(F.lit(1.0), units, F.lit("360_day")))


def test_other_labels(spark):
    assert one(spark, S.decode_xtime(F.lit("2024-01-31_12:30:00 "))) == "2024-01-31T12:30:00Z"
    assert one(spark, S.decode_xtime(F.lit("2024-02-31_12:30:00"))) is None
    assert one(spark, S.compact(F.lit(100.0))) == "100" and one(spark, S.compact(F.lit(0.5))) == "0.5"
    assert one(spark, S.slug(F.lit("Dust 2.5 µm--x."))) == "dust_2p5_m_xp"
    none = F.lit(None).cast("string")
    label = S.level_label(none, F.lit("air_pressure"), F.lit("pfull"), F.lit(500.0), F.lit("mbar"), F.lit(1), F.lit(3))
    assert one(spark, label) == "air_pressure 500 mbar (index 1 of 2)"
    assert one(spark, S.plane_name(F.lit("a b"), F.lit("O3/x"), F.lit(3), F.lit(12))) == "a_b_O3_x_t0003_z0012"
    assert one(spark, S.to_degrees(F.lit(math.pi), F.lit("rad"))) == pytest.approx(180.0)
    assert one(spark, S.to_degrees(F.lit(3.0), F.lit("Degrees_north"))) == 3.0
    assert one(spark, S.parse_label(F.lit("2024-01-01T00:00:00z"))) is not None
    assert one(spark, S.parse_label(F.lit("t=4"))) is None


def test_transpose(spark):
    got = transpose(plane_cells(spark, [1, 2, 3, 4, 5, 6], cols=3)).filter("r = 2 AND c = 1").first()
    assert got["raw"] == 6.0


# --- the classic field fixture: 3 dates x 4 lat x 5 lon -------------------------------


@pytest.fixture(scope="module")
def coards(spark):
    rows = []
    for d in (1, 2):
        for name, base in (("MACCity", 1), ("Pixel_area", 101)):
            for i in range(60):
                rows.append((d, name, i // 20, 0, i % 20 // 5, i % 5, float(base + i)))
    attrs = spark.createDataFrame(
        [(d, v, 9.96921e36, None, None, None, None, None, None) for d in (1, 2) for v in ("MACCity", "Pixel_area")], ATTRS
    )
    dims = spark.createDataFrame(
        [(d, n, k, r) for d in (1, 2) for n, k, r in (("date", 3, "time"), ("lat", 4, "latitude"), ("lon", 5, "longitude"))],
        "dataset_id INT, dim STRING, length INT, role STRING",
    )
    vars_ = spark.createDataFrame(
        [(d, p, v, ["date", "lat", "lon"], True, None, None, None) for d in (1, 2) for p, v in enumerate(("MACCity", "Pixel_area"))],
        "dataset_id INT, pos INT, variable STRING, dims ARRAY<STRING>, numeric BOOLEAN, units STRING, long_name STRING, standard_name STRING",
    )
    cells = decode(spark.createDataFrame(rows, CELLS), attrs)
    return GridSet(cells=cells, vars=vars_, dims=dims, attrs=attrs)


def cell(df, t, r, c, dataset=1):
    return df.filter(f"t = {t} AND r = {r} AND c = {c} AND dataset_id = {dataset}").first()


def test_formula_in_one_dataset(coards):
    out = E.derive(coards, "s", [E.ref("MACCity"), E.ref("Pixel_area")], lambda a, b: a + b * 2).cache()
    assert cell(out, 1, 0, 0)["value"] == 263.0 and cell(out, 1, 3, 4, 2)["value"] == 320.0
    assert out.count() == 120


def test_formula_across_datasets(coards):
    out = E.derive(coards, "q", [E.ref("MACCity", 2), E.ref("Pixel_area", 1)], ieee_div)
    assert cell(out, 0, 0, 0, 2)["value"] == 1 / 101
    assert out.select("dataset_id").distinct().collect()[0][0] == 2


def test_formula_results_stay_visible(coards):
    out = E.derive(coards, "l", [E.ref("MACCity")], lambda a: ieee_log(a - 10.0)).cache()
    assert cell(out, 0, 0, 0)["validity"] == "NaN"
    assert cell(out, 0, 1, 4)["validity"] == "NegInf" or cell(out, 0, 1, 4)["value"] == -INF
    assert cell(out, 0, 3, 4)["value"] == math.log(10)
    assert cell(E.derive(coards, "i", [E.ref("MACCity")], lambda a: ieee_div(a, 0.0)), 0, 0, 0)["validity"] == "PosInf"


def test_time_reductions(coards):
    macc = coards.variable("MACCity", 1)
    got = {how: R.reduce_axis(macc, "time", how).filter("r = 0 AND c = 0").first()["value"] for how in ("mean", "sum", "min", "max")}
    assert got == {"mean": 21.0, "sum": 63.0, "min": 1.0, "max": 41.0}
    # a single level: a layer reduction returns the field
    assert R.layer_mean(macc).filter("t = 2 AND r = 0 AND c = 0").first()["value"] == 41.0
    by_formula = E.derive(coards, "m", [E.ref("MACCity")], lambda a: a, over=("time", "mean"))
    assert cell(by_formula, 0, 0, 0)["value"] == 21.0


def test_missing_is_skipped_and_nan_poisons(spark):
    frames = spark.createDataFrame(
        [(1, "x", t, 0, 0, c, v) for t, row in enumerate([[1.0, None, NAN], [3.0, None, 2.0]]) for c, v in enumerate(row)],
        "dataset_id INT, variable STRING, t INT, z INT, r INT, c INT, v DOUBLE",
    )
    out = {}
    for how in ("mean", "min", "max", "sum"):
        rows = reclassify(R.reduce_column(frames, "v", "time", how, "result")).orderBy("c").collect()
        out[how] = [(r["validity"], r["value"]) for r in rows]
    assert out["mean"][0] == ("Finite", 2.0)
    for how in out:
        assert out[how][1][0] == "Missing" and out[how][2][0] == "NaN"


def test_missing_in_arithmetic(spark):
    df = spark.createDataFrame([(4.0,), (None,)], "x DOUBLE").withColumn("result", F.sqrt("x") + 1)
    rows = reclassify(df.select("result")).collect()
    assert [(r["validity"]) for r in rows] == ["Finite", "Missing"] and rows[0]["value"] == 3.0


def test_static_field_is_reused(spark, coards):
    static = coards.variable("Pixel_area", 1).filter("t = 0").withColumn("variable", F.lit("area"))
    names = coards.vars.filter("variable = 'MACCity' AND dataset_id = 1").withColumn("variable", F.lit("area")).withColumn(
        "dims", F.array(F.lit("lat"), F.lit("lon"))
    )
    gs = GridSet(cells=coards.cells.unionByName(static), vars=coards.vars.unionByName(names), dims=coards.dims)
    out = E.derive(gs, "per", [E.ref("MACCity"), E.ref("area")], ieee_div)
    assert cell(out, 2, 0, 0)["value"] == 41 / 101
    # only dataset 1 has the field
    assert [r[0] for r in out.select("dataset_id").distinct().collect()] == [1]


def test_binding_errors(spark, coards):
    with pytest.raises(GridError, match="not a valid formula name"):
        E.derive(coards, "1x", [E.ref("MACCity")], lambda a: a)
    with pytest.raises(GridError, match="already a variable name"):
        E.derive(coards, "MACCity", [E.ref("Pixel_area")], lambda a: a)
    with pytest.raises(GridError, match="plottable"):
        E.derive(coards, "n", [E.ref("nothing")], lambda a: a)
    with pytest.raises(GridError, match="at least one"):
        E.derive(coards, "n", [], lambda: F.lit(1.0))
    short = coards.dims.withColumn("length", F.when((F.col("dataset_id") == 2) & (F.col("dim") == "date"), 2).otherwise(F.col("length")))
    uneven = GridSet(cells=coards.cells, vars=coards.vars, dims=short)
    with pytest.raises(GridError, match="numbers of steps"):
        E.derive(uneven, "n", [E.ref("MACCity", 1), E.ref("MACCity", 2)], lambda a, b: a - b)
    narrow = coards.dims.withColumn("length", F.when((F.col("dataset_id") == 2) & (F.col("dim") == "lon"), 4).otherwise(F.col("length")))
    with pytest.raises(GridError, match="different shapes"):
        E.derive(GridSet(cells=coards.cells, vars=coards.vars, dims=narrow), "n", [E.ref("MACCity", 1), E.ref("MACCity", 2)], lambda a, b: a - b)


def test_apply_formulas_reports_what_no_dataset_accepts(coards):
    rows, errors = E.apply_formulas(coards, [
        E.Derived("a", (E.ref("MACCity"),), lambda x: x * 2),
        E.Derived("b", (E.ref("a"),), lambda x: x),  # formulas do not see formulas
        E.Derived("c", (E.ref("MACCity", 2), E.ref("MACCity", 1)), lambda x, y: x - y),
    ])
    assert len(errors) == 1 and errors[0].startswith("b:")
    got = {(r["variable"], r["dataset_id"]) for r in rows.select("variable", "dataset_id").distinct().collect()}
    assert got == {("a", 1), ("a", 2), ("c", 2)}


def test_formulas_share_one_scan(spark, coards, scratch):
    from gridspark.sources.grid import read_grid, write_grid

    # cells that one of the references lacks
    holed = coards.cells.filter("NOT (variable = 'Pixel_area' AND r = 1)")
    write_grid(GridSet(cells=holed, vars=coards.vars, dims=coards.dims, attrs=coards.attrs), scratch + "/f")
    gs = read_grid(spark, scratch + "/f")
    formulas = [
        E.Derived("a", (E.ref("MACCity"),), lambda x: x * 2),
        E.Derived("s", (E.ref("MACCity"), E.ref("Pixel_area")), lambda x, y: x + y),
        E.Derived("c", (E.ref("MACCity", 2), E.ref("MACCity", 1)), lambda x, y: x - y),
        E.Derived("p", (E.ref("Pixel_area"),), lambda x: F.coalesce(x, F.lit(0.0)) - 1),
    ]
    rows, errors = E.apply_formulas(gs, formulas)
    assert errors == []
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert sum("raw#" in line for line in plan.splitlines() if "Relation [" in line) == 1
    for d in formulas:
        one = E.derive(gs, d.name, list(d.refs), d.expr)
        same = lambda df: sorted(tuple(map(str, r)) for r in df.select("dataset_id", "t", "z", "r", "c", "value", "validity").collect())
        assert same(rows.filter(F.col("variable") == d.name)) == same(one), d.name


def test_anomaly_and_derived_catalogue(coards):
    out = E.anomaly(coards.variable("MACCity", 1))
    assert [cell(out, t, 0, 0)["value"] for t in (0, 1, 2)] == [-20.0, 0.0, 20.0]
    d = E.Derived("m", (E.ref("MACCity", 1),), lambda a: a, ("time", "mean"), "time_mean(MACCity[1])")
    row = E.derived_vars(coards, d).first()
    assert row["dims"] == ["lat", "lon"] and row["units"] is None and row["long_name"] == "time_mean(MACCity[1])"


def test_plane_bounds(coards):
    rows = P.plane(coards, "MACCity", 1, 0, P.Bounds(1, 3, 2, 4)).orderBy("r", "c").collect()
    assert [r["value"] for r in rows] == [28.0, 29.0, 33.0, 34.0]
    for bad in (lambda: P.plane(coards, "MACCity", 3), lambda: P.plane(coards, "MACCity", 0, 0, P.Bounds(0, 5, 0, 1)),
                lambda: P.Bounds(2, 2, 0, 1), lambda: P.plane(coards, "nope")):
        with pytest.raises(GridError):
            bad()
    # a static axis takes any index
    assert P.plane(coards, "MACCity", 0, 7).count() == 20
    assert P.axis_index(5, 1) == 0


def test_pushdown_reaches_the_scan(spark, coards, scratch):
    from gridspark.sources.grid import read_grid, write_grid

    write_grid(coards, scratch + "/g")
    gs = read_grid(spark, scratch + "/g")
    df = P.plane(gs, "MACCity", 1, 0, P.Bounds(0, 2, 0, 2), 2)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull" in plan and "EqualTo(t,1)" in plan and "LessThan(r,2)" in plan
    assert df.count() == 4


def test_extra_dimensions(spark):
    rows = [(h, w, {"kernel": k, "retrieval": q}, float(h * 100 + w * 10 + k + q * 1000)) for h in range(3) for w in range(4) for k in range(3) for q in range(2)]
    df = spark.createDataFrame(rows, "r INT, c INT, extra MAP<STRING, INT>, raw DOUBLE")
    lengths = {"kernel": 3, "retrieval": 2, "r": 3, "c": 4}
    one_ = P.plane_on(df, "r", "c", {"kernel": 2, "retrieval": 1}, lengths)
    assert one_.filter("r = 2 AND c = 3").first()["raw"] == 1232.0 and one_.count() == 12
    turned = P.plane_on(df, "kernel", "c", {"r": 1, "retrieval": 0}, lengths)
    assert turned.filter("r = 2 AND c = 3").first()["raw"] == 132.0
    assert P.fix_extra(df, {"kernel": 9, "retrieval": -4}, lengths).count() == 12
    for bad in ({"r": 3, "retrieval": 0}, {"r": 0, "c": 0}):
        with pytest.raises(GridError):
            P.plane_on(df, "kernel", "c", bad, lengths)
    with pytest.raises(GridError):
        P.plane_on(df, "r", "r", {}, lengths)


def test_axis_boxes(spark):
    def box(values, lo, hi, kind="linear"):
        axis = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "dataset_id INT, idx INT, coord DOUBLE")
        row = P.bbox_axis(axis, lo, hi, kind).first()
        return (row["first"], row["last"] + 1) if row else None

    assert box([0, 10, 20, 30], 10, 20) == (1, 3) and box([30, 20, 10, 0], 10, 20) == (1, 3)
    assert box([0, NAN, 20, 30], 5, 25) == (2, 3) and box([0, 10], 40, 50) is None
    assert box([0, 90, 180, 270, 360], 260, 300, "longitude") == (3, 4)
    assert box([0, 90, 180, 270, 360], -100, -60, "longitude") == (3, 4)
    assert box([0, 90, 180, 270, 360], -90, 0, "longitude") == (3, 5)
    assert box([-180, -90, 0, 90, 180], 260, 300, "longitude") == (1, 2)
    assert box([0, 90, 180, 270, 360], 0, 360, "longitude") == (0, 5)
    for lo, hi, kind in ((NAN, 1, "linear"), (2, 1, "linear"), (-91, 0, "latitude"), (-181, 0, "longitude"), (-180, 181, "longitude")):
        with pytest.raises(GridError):
            box([0, 10, 20], lo, hi, kind)
    with pytest.raises(Exception, match="seam"):
        box([0, 90, 180, 270, 360], -10, 10, "longitude")


def test_index_and_curvilinear_boxes(spark):
    assert P.index_box(1, 3, 4) == (1, 3)
    for bad in ((0.5, 2, 4), (-1, 2, 4), (0, 4, 4), (0, 0, 0)):
        with pytest.raises(GridError):
            P.index_box(*bad)
    grid = spark.createDataFrame(
        [(1, r, c, -10.0 + 10 * r, 10.0 * c) for r in range(3) for c in range(3)], "dataset_id INT, r INT, c INT, lat DOUBLE, lon DOUBLE"
    )
    row = P.bbox_2d(grid, (5.0, 15.0), (-5.0, 5.0)).first()
    assert (row["r0"], row["r1"], row["c0"], row["c1"], row["approximate"]) == (1, 1, 1, 1, True)


def test_boxes_on_signed_coordinates_that_overhang_the_seam(spark):
    lons = [-179.5, -90.0, -30.0, 0.0, 30.0, 90.0, 180.5]
    grid = spark.createDataFrame([(1, 0, c, 0.0, x) for c, x in enumerate(lons)], "dataset_id INT, r INT, c INT, lat DOUBLE, lon DOUBLE")
    axis = grid.select("dataset_id", F.col("c").alias("idx"), F.col("lon").alias("coord"))
    for lo, hi, want in ((-60.0, 45.0, (2, 4)), (-100.0, -20.0, (1, 2)), (20.0, 100.0, (4, 5)), (170.0, 190.0, (0, 6))):
        box, line = P.bbox_2d(grid, (lo, hi), (-5.0, 5.0)).first(), P.bbox_axis(axis, lo, hi, "longitude").first()
        assert (box["c0"], box["c1"]) == want and (line["first"], line["last"]) == want
    with pytest.raises(GridError, match="seam"):
        P.bbox_2d(grid.filter("lon >= 0"), (-60.0, 45.0), (-5.0, 5.0))


def test_difference(spark):
    cells = plane_cells(spark, [100, 50, -10, 0], 1).unionByName(plane_cells(spark, [90, 60, 20, 0], 2)).unionByName(
        plane_cells(spark, [1, 2], 3, cols=1)
    )
    attrs = spark.createDataFrame([(d, "x") for d in (1, 2, 3)], "dataset_id INT, variable STRING")
    dims = spark.createDataFrame(
        [(d, n, k, r) for d, c in ((1, 2), (2, 2), (3, 1)) for n, k, r in (("y", 2, "latitude"), ("x", c, "longitude"))],
        "dataset_id INT, dim STRING, length INT, role STRING",
    )
    vars_ = spark.createDataFrame([(d, "x", ["y", "x"], True) for d in (1, 2, 3)], "dataset_id INT, variable STRING, dims ARRAY<STRING>, numeric BOOLEAN")
    gs = GridSet(cells=decode(cells, attrs), vars=vars_, dims=dims)
    assert [r["value"] for r in diff(gs, 1, 2).orderBy("r", "c").collect()] == [10.0, -10.0, -30.0, 0.0]
    assert diff(gs, 1, 3).count() == 0  # other lengths: not comparable
    # a cell on one side only is missing, never NaN
    holed = GridSet(cells=gs.cells.filter("NOT (dataset_id = 2 AND r = 0 AND c = 0)"), vars=vars_, dims=dims)
    assert diff(holed, 1, 2).filter("r = 0 AND c = 0").first()["validity"] == "Missing"
    assert diff(holed, 1, 2, emit_missing=False).count() == 3


@pytest.mark.parametrize("n,m,want", [(3, 3, [(1, 11), (2, 12), (3, 13)]), (1, 3, [(1, 11), (1, 12), (1, 13)]), (3, 1, [(1, 11), (2, 11), (3, 11)]), (2, 3, [(1, 11), (2, 12)])])
def test_pairing_of_sets(spark, n, m, want):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(1, n + 1)] + [(1, "a1")], "dataset_id INT, path STRING")
    b = spark.createDataFrame([(10 + i, f"b{i}") for i in range(1, m + 1)], "dataset_id INT, path STRING")
    assert sorted((r["a"], r["b"]) for r in pair_sets(a, b).collect()) == want


def test_north_up(spark):
    axis = spark.createDataFrame([(1, 0, 0, -45.0), (1, 1, 0, 45.0), (2, 0, 0, 45.0), (2, 1, 0, -45.0)], "dataset_id INT, r INT, c INT, lat DOUBLE")
    from gridspark.operators.catalog import lat_ascending

    n = axis.groupBy("dataset_id").agg((F.max("r") + 1).alias("rows"))
    cells = plane_cells(spark, [10, 20], 1, cols=1).unionByName(plane_cells(spark, [20, 10], 2, cols=1))
    rows = P.north_up(cells, lat_ascending(axis), n).orderBy("dataset_id", "display_row").collect()
    assert [r["raw"] for r in rows] == [20.0, 10.0, 20.0, 10.0]


def test_leading_axes_follow_roles(coards):
    row = leading_axes(coards.vars, coards.dims).first()
    assert (row["time_axis"], row["depth_axis"], row["row_axis"], row["col_axis"], row["n_time"]) == (0, None, 1, 2, 3)


def test_lookup_join_without_broadcast_gives_the_same(spark):
    big = spark.range(100).withColumn("k", F.col("id") % 7)
    small = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a = lookup_join(big, small, ["k"]).orderBy("id").collect()
    b = lookup_join(big, small, ["k"], max_rows=1).orderBy("id").collect()
    assert a == b


def test_labels_beyond_the_year_9999(spark):
    label = lambda days: one(spark, S.decode_time(F.lit(float(days)), F.lit("days since 1995-1-1")))
    assert label(2923765) == "9999-12-31T00:00:00Z" and label(2923766) == "10000-01-01T00:00:00Z"
