"""Catalogue, collections, series, distributions, colours, indexes, manifests and streams."""

import base64
import gzip
import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridspark.model import GridError, GridSet
from gridspark.operators import binning as B
from gridspark.operators import catalog as C
from gridspark.operators import collection as K
from gridspark.operators import distribution as H
from gridspark.operators import msgindex as X
from gridspark.operators import series as T
from gridspark.operators.derive import Derived, ref
from gridspark.sources import grid as G
from gridspark.sources import manifest as M
from gridspark.sources import text as TX
from gridspark.streaming import collection as L

NAN = float("nan")
PLANE = "dataset_id INT, variable STRING, t INT, z INT, r INT, c INT, value DOUBLE, validity STRING"


def plane(spark, values, cols, validity="Finite"):
    return spark.createDataFrame([(1, "x", 0, 0, i // cols, i % cols, float(v), validity) for i, v in enumerate(values)], PLANE)


# --- catalogue ------------------------------------------------------------------------


def test_roles(spark):
    rows = [
        ("a", 1, "T", None, None, None, None, "time"), ("x", 1, None, None, "Degrees_East", None, None, "longitude"),
        ("lev", 1, "q", None, None, None, None, "depth"), ("p", 1, None, None, None, "down", None, "depth"),
        ("p", 2, None, None, None, "down", None, "other"), ("t0", 1, None, None, "days since 1-1-1", None, None, "time"),
        ("lat", 1, None, None, None, None, "longitude", "longitude"), ("pfull", 1, None, "Z", None, None, None, "depth"),
    ]
    df = spark.createDataFrame(rows, "variable STRING, rank INT, axis STRING, cartesian_axis STRING, units STRING, positive STRING, standard_name STRING, want STRING")
    assert all(r["role"] == r["want"] for r in C.axis_roles(df).collect())
    names = spark.createDataFrame([("northing",), ("step",), ("hybrid",), ("level2",)], "n STRING")
    got = {p: [r[0] for r in names.select(C.role_from_name(F.col("n"), p)).collect()] for p in ("netcdf4", "manifest", "netcdf3")}
    assert got == {"netcdf4": ["other", "other", "depth", "other"], "manifest": ["latitude", "time", "other", "depth"], "netcdf3": ["other", "other", "other", "depth"]}


def test_grid_class(spark):
    schema = "dataset_id INT, r INT, c INT, lat DOUBLE, lon DOUBLE"
    def grid(d, lat, lon, cols=2):
        return [(d, i // cols, i % cols, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    rows = grid(1, [0, .2, 1, 1.2], [0, 1, .1, 1.1]) + grid(2, [0, 0, 1, 1], [5, 6, 5, 6]) + grid(3, [0, 0, 1], [5, 6, 5]) + grid(4, [0, 3, 9], [1, 1, 2], 3)
    got = {r["dataset_id"]: r["grid_class"] for r in C.classify_grid(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "curvilinear", 2: "rectilinear", 3: None, 4: "rectilinear"}


def test_search_is_ordered_and_literal(spark):
    v = spark.createDataFrame([("Temp.x",), ("tempax",), ("TX",), ("ozone",)], "variable STRING")
    assert [r[0] for r in C.search_variables(v, "T.X").collect()] == ["Temp.x"]
    assert [r[0] for r in C.search_variables(v, "tx").collect()] == ["Temp.x", "tempax", "TX"]
    assert C.search_variables(v, "").count() == 4


# --- collections ----------------------------------------------------------------------


def collection(spark):
    rows = [(0, 2, "K"), (1, 1, "K"), (2, 1, "C")]
    vars_ = spark.createDataFrame([(d, 0, "temperature", ["time", "latitude", "longitude"], True, u, None, None) for d, _, u in rows] + [(0, 1, "only", ["latitude", "longitude"], True, None, None, None)],
        "dataset_id INT, pos INT, variable STRING, dims ARRAY<STRING>, numeric BOOLEAN, units STRING, long_name STRING, standard_name STRING")
    dims = spark.createDataFrame([x for d, n, _ in rows for x in ((d, "time", n, "time"), (d, "latitude", 2, "latitude"), (d, "longitude", 2, "longitude"))],
        "dataset_id INT, dim STRING, length INT, role STRING")
    labels = spark.createDataFrame([(0, 0, "2026-01-01T00:00:00Z"), (0, 1, "2026-01-01T03:00:00z"), (1, 0, "2025-12-31T06:00:00Z"), (2, 0, "2026-01-01T00:00:00Z")], "dataset_id INT, t INT, label STRING")
    return GridSet(cells=None, vars=vars_, dims=dims), labels


def test_collection(spark):
    gs, labels = collection(spark)
    frames = K.frames(gs, labels)
    temp = frames.filter("variable = 'temperature'")
    line = K.timeline(temp).orderBy("t_global").collect()
    assert [(r["dataset_id"], r["t"]) for r in line] == [(1, 0), (0, 0), (2, 0), (0, 1)]
    notes = {(r["variable"], r["dataset_id"], r["kind"]): r["message"] for r in K.compatibility(gs).collect()}
    assert set(notes) == {("temperature", 2, "differs"), ("only", 1, "missing")}
    assert notes[("only", 1, "missing")] == "only: not in sources 1 to 2"
    each = {(r["variable"], r["dataset_id"], r["kind"]) for r in K.compatibility(gs, expand=True).collect()}
    assert each == {("temperature", 2, "differs"), ("only", 1, "missing"), ("only", 2, "missing")}
    assert [tuple(r) for r in K.missing_runs(gs).collect()] == [("only", 0, 1, 2, 2)]
    assert notes[("temperature", 2, "differs")] == "temperature: sources 0 and 2 disagree on units"
    dup = K.duplicate_labels(temp).collect()
    assert [(r["dataset_id"], r["previous_dataset"], r["previous_t"]) for r in dup] == [(2, 0, 0)]
    bad = spark.createDataFrame([("temperature",)], "variable STRING")
    assert [r["dataset_id"] for r in K.timeline(temp, bad, active=1).collect()] == [1]
    assert K.earliest(frames).first()["dataset_id"] == 1
    assert K.agg_label(temp).filter("dataset_id = 0").first()["label"] == "2026-01-01T00:00:00Z to 2026-01-01T03:00:00z"
    assert K.placeholder(gs.vars, K.timeline(temp), 0).first()["label"] == "coordinate index"


def test_coordinate_compatibility(spark):
    axes = spark.createDataFrame(
        [(d, "lat", i, v) for d, vs in ((0, [0.0, 1.0, NAN]), (1, [0.0, 1.0 + 1e-13, NAN]), (2, [0.0, 1.1, NAN]), (3, [0.0, 1.0])) for i, v in enumerate(vs)],
        "dataset_id INT, dim STRING, idx INT, coord DOUBLE")
    vars_ = spark.createDataFrame([(d, "x", ["lat"]) for d in range(4)], "dataset_id INT, variable STRING, dims ARRAY<STRING>")
    got = {r["dataset_id"] for r in K.coord_compat(GridSet(cells=None, axes=axes), vars_).collect()}
    assert got == {2, 3}
    grid = spark.createDataFrame([(d, r, c, float(r), float(c) + (0.5 if d == 1 and r == 1 and c == 1 else 0)) for d in (0, 1, 2) for r in range(2) for c in range(2 + (d == 2))],
        "dataset_id INT, r INT, c INT, lat DOUBLE, lon DOUBLE")
    rows = K.corner_compat(GridSet(cells=None, coord2d=grid), vars_.filter("dataset_id < 3")).orderBy("dataset_id").collect()
    assert [rows[0]["message"], rows[1]["message"]] == ["x: sources 0 and 1 have grids in different places", "x: sources 0 and 2 have grids of different shapes"]


# --- series, distributions, colours -----------------------------------------------------


def test_corners_are_hashed_and_references_not_shuffled(spark, monkeypatch):
    """Corners of fixed width need no sort of all cells, and a reference many datasets share is no join key of theirs."""
    plans, cut = [], K.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(K, "cut_lineage", seen)
    nan, cells = NAN, []
    for d, first, last in ((1, (0.0, 5.0), (1.0, 9.0)), (2, (0.0, 5.0), (1.0, 9.0)), (3, (0.0, 5.0), (1.0, 8.0)), (4, (nan, 5.0), (1.0, 9.0)), (5, (None, 5.0), (1.0, 9.0))):
        cells += [(d, 0, 0, *first), (d, 0, 11, 2.0, 2.0), (d, 1, 0, 3.0, 3.0), (d, 1, 11, *last)]
    cells += [(6, 0, 0, 0.0, 5.0), (6, 2, 11, 1.0, 9.0)]
    grid = spark.createDataFrame(cells, "dataset_id INT, r INT, c INT, lat DOUBLE, lon DOUBLE")
    held = spark.createDataFrame([(v, d) for v in ("x", "y") for d in range(1, 7) if (v, d) != ("y", 1)], "variable STRING, dataset_id INT")
    out = K.corner_compat(GridSet(cells=None, coord2d=grid), held)
    got = {(r["variable"], r["dataset_id"], r["reference_id"]): r["message"].split("have ")[1] for r in out.collect()}
    other, shape = "grids in different places", "grids of different shapes"
    assert got == {(v, d, i): shape if d == 6 else other for v, i in (("x", 1), ("y", 2)) for d in (3, 4, 5, 6)}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 1 and not any("SortAggregate" in p or "ObjectHashAggregate" in p for p in plans)
    assert not any("hashpartitioning(reference_id" in p for p in plans)


def test_time_series_keeps_gaps(spark):
    cells = plane(spark, [1, 2, 3, 4], 2)
    line = spark.createDataFrame([("x", 0, 1, 0, "a"), ("x", 1, 7, 0, "b")], "variable STRING, t_global INT, dataset_id INT, t INT, label STRING")
    rows = T.time_series(cells, line, [(1, 1), (5, 5)]).orderBy("point", "x").collect()
    assert [r["y"] for r in rows][0] == 4.0 and all(np.isnan(r["y"]) for r in rows[1:]) and len(rows) == 4
    assert T.series_summary(T.time_series(cells, line, [(1, 1)]), ["point"]).first()["finite_samples"] == 1
    summary = T.domain_summary(cells, line).orderBy("t_global").collect()
    assert (summary[0]["mean"], summary[0]["minimum"], summary[0]["maximum"]) == (2.5, 1.0, 4.0) and np.isnan(summary[1]["mean"])


def test_histogram(spark):
    bins = H.histogram(plane(spark, [0, 1, 2, 3, 4, 10], 6), ["variable"]).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [3, 2, 0, 1]  # ceil(log2 6) + 1 bins; the last one is closed
    flat = H.histogram(plane(spark, [5, 5], 2), ["variable"], density=True).collect()
    assert len(flat) == 1 and flat[0]["height"] == 100.0
    whole = H.histogram(plane(spark, [0, 1, 2, 3, 4, 10], 6), []).orderBy("bin").collect()
    assert [b["count"] for b in whole] == [3, 2, 0, 1]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10])
def test_blocks_cover_what_they_should(spark, n):
    rows = spark.range(10).select(F.col("id").alias("s"), B.block_of(F.col("id"), 10, n).alias("b")).collect()
    for r in rows:
        assert r["b"] * 10 // n <= r["s"] < (r["b"] + 1) * 10 // n


def test_block_means_and_filter(spark):
    df = plane(spark, [1, 2, 3, 4, 50, 60, 70, 80], 4)
    out = {(r["bin_r"], r["bin_c"]): (r["value"], r["filtered"]) for r in B.bin_grid(df, 2, 4, 2, 2).collect()}
    assert B.fit_size(2, 4, 2, 2) == (1, 2) and out == {(0, 0): (28.25, False), (0, 1): (39.25, False)}
    assert B.fit_size(10, 20, 4, 100) == (4, 8) and B.fit_size(3, 3, 9, 9) == (3, 3)
    cut = {(r["bin_r"], r["bin_c"]): (r["value"], r["filtered"]) for r in B.bin_grid(df, 2, 4, 2, 4, (0.0, 10.0), lat_ascending=True).collect()}
    assert cut[(0, 0)] == (None, True) and cut[(1, 3)] == (4.0, False)
    # the limit on columns alone is tight
    wide = {(r["bin_r"], r["bin_c"]): r["value"] for r in B.bin_grid(df, 2, 4, 2, 2, keep_rows=True).collect()}
    assert wide == {(0, 0): 1.5, (0, 1): 3.5, (1, 0): 55.0, (1, 1): 75.0}


def test_limits_and_colours(spark):
    df = plane(spark, [-10, 10, -100, 0], 2)
    lim = lambda **k: tuple(B.limits(df, ["variable"], **k).select("lo", "hi").first())
    assert lim() == (-100.0, 10.0) and lim(scale="log", is_diff=True) == (10.0, 100.0) and lim(scale="log") == (10.0, 10.0)
    assert tuple(B.limits(plane(spark, [0, 0], 2), ["variable"]).select("lo", "hi").first()) == (-0.5, 0.5)
    with pytest.raises(GridError):
        B.scoped_limits(df, ["variable"], manual=(1.0, 1.0))
    assert tuple(B.scoped_limits(df, ["variable"], manual=(1.0, 2.0)).select("lo", "hi").first()) == (1.0, 2.0)
    pal = spark.createDataFrame([("p", 0, 0, 0, 0), ("p", 1, 255, 100, 1)], "name STRING, idx INT, red INT, green INT, blue INT")
    table = B.colour_table(pal).orderBy("idx").collect()
    assert len(table) == 256 and table[0]["red"] == 0 and table[128]["red"] == 128 and table[255]["green"] == 100
    back = B.colour_table(pal, reverse=True).orderBy("idx").collect()
    assert [r["red"] for r in back] == [r["red"] for r in table][::-1]
    rows = plane(spark, [0, 5, 10, 99], 4).withColumn("validity", F.when(F.col("c") == 1, "Fill").otherwise(F.col("validity")))
    edge = spark.createDataFrame([("x", 0.0, 10.0)], "variable STRING, lo DOUBLE, hi DOUBLE")
    got = [(r["red"], r["green"], r["blue"]) for r in B.colourise(rows, edge, ["variable"], pal, "p", value_filter=(0.0, 50.0)).orderBy("c").collect()]
    assert got == [(0, 0, 0), (80, 80, 80), (255, 100, 1), (30, 30, 46)]


# --- index text and palettes ------------------------------------------------------------


def test_index_files(spark, scratch):
    with open(f"{scratch}/a.idx", "w") as f:
        f.write("# head\n\n1:0:d=2026091100:TMP:surface\n2:32:d=2026091100:RH:surface\n")
    lines = TX.read_idx(spark, f"{scratch}/*.idx")
    obj = lines.first()["object"]
    size = spark.createDataFrame([(obj, 48)], "object STRING, size BIGINT")
    rows = X.parse_idx(lines, size).orderBy("ordinal").collect()
    assert [(r["line"], r["length"]) for r in rows] == [(3, 32), (4, 16)]

    def faults(*text):
        df = spark.createDataFrame([("o", i + 1, t) for i, t in enumerate(text)], "object STRING, line BIGINT, text STRING")
        s = spark.createDataFrame([("o", 48)], "object STRING, size BIGINT")
        return [r["reason"] for r in X.validate_idx(df, s).collect()], df, s

    assert faults("0:0:x")[0] == ["ordinals count from 1, found 0"]
    assert faults("2:0:x")[0] == ["counting does not begin at 1"]
    assert faults("1:40:x", "2:30:y")[0] == ["offset does not lie after the previous one"]
    assert faults("1:48:x")[0] == ["the offset lies past the end of the object"]
    _, df, s = faults("1:40:x", "2:30:y")
    with pytest.raises(GridError, match="line 2"):
        X.parse_idx(df, s)
    assert X.parse_idx(df, s, strict=False).count() == 0


def test_palette_files(spark, scratch):
    for name, text in (("good", "0 0 0 # black\n\n255 255 255\n"), ("wide", "0 0 0\n256 0 0\n"), ("short", "1 2 3\n"), ("words", "1 2\n3 4 5\n")):
        with open(f"{scratch}/{name}.ncmap", "w") as f:
            f.write(text)
    rows = TX.read_palettes(spark, f"{scratch}/*.ncmap").orderBy("idx").collect()
    assert [(r["name"], r["idx"], r["blue"]) for r in rows] == [("good", 0, 0), ("good", 1, 255)]


def test_raw_codes_and_forecasts(spark):
    h = spark.createDataFrame([(0, 13, 193, 0, 0, 0), (0, None, None, 0, 1, 2)], "discipline INT, category INT, number INT, grid_template INT, product_template INT, data_template INT")
    assert [r[0] for r in h.select(X.raw_code_label()).collect()] == ["d0-c13-p193-g0-t0-r0", "d0-cx-px-g0-t1-r2"]
    p = spark.createDataFrame([("s3://b/g.t00z.f003.grib2",), ("s3://b/g.t00z.f006.grib2",)], "path STRING")
    assert X.is_forecast_collection(p).first()["is_collection"]
    assert not X.is_forecast_collection(p.unionByName(spark.createDataFrame([("s3://b/x.f003.nc",)], "path STRING"))).first()["is_collection"]


def test_packed_documents_are_read_in_small_pieces(spark, scratch):
    """A reader holds the texts of a row group at once: it is bounded by its text, however few documents that are."""
    entry = F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda i: F.concat(F.lit('"grib2_message_'), i, F.lit('/0":["object",'), i * 137, F.lit(",137]")))
    docs = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("name"), F.concat("id", F.lit("{"), F.array_join(entry, ","), F.lit("}")).alias("text"))
    TX.write_documents(docs, scratch + "/packed")
    sizes = []
    for file in Path(scratch + "/packed").glob("*.parquet"):
        found = pq.ParquetFile(file).metadata
        sizes += [found.row_group(i).total_byte_size for i in range(found.num_row_groups)]
    assert sum(sizes) > 64 << 20 and max(sizes) < 32 << 20 and len(sizes) < 100
    assert sorted(TX.read_documents(spark, scratch + "/packed").collect()) == sorted(docs.collect())


def test_lines_of_packed_documents(spark, scratch):
    texts = {"good": "# head\n0 0 0 # black\n\n255 255 255\n", "wide": "0 0 0\r\n256 0 0", "short": "1 2 3", "none": ""}
    for name, text in texts.items():
        with open(f"{scratch}/{name}.ncmap", "w", newline="") as f:
            f.write(text)
    TX.write_documents(spark.createDataFrame([(f"{n}.ncmap", t) for n, t in texts.items()], "name STRING, text STRING"), scratch + "/packed")
    lines = TX.document_lines(TX.read_documents(spark, scratch + "/packed"))
    files = TX.numbered_lines(spark, f"{scratch}/*.ncmap").withColumn("path", F.regexp_extract("path", "([^/]*)$", 1))
    same = lambda df: sorted(map(tuple, df.select("path", "line", "text").collect()))
    assert same(lines) == same(files) and lines.count() == 7
    assert [(r["name"], r["idx"], r["blue"]) for r in TX.parse_palettes(lines).orderBy("idx").collect()] == [("good", 0, 0), ("good", 1, 255)]


# --- manifests ----------------------------------------------------------------------------


def b64(data):
    return "base64:" + base64.b64encode(data).decode()


def opened(spark, refs, **more):
    docs = spark.createDataFrame([("m", json.dumps({"refs": refs, **more}))], "manifest STRING, text STRING")
    arrays, chunks = M.open_manifests(docs)
    return arrays, M.chunk_index(chunks, arrays)


def values(df):
    return [r["raw"] for r in df.orderBy("t", "z", "r", "c").collect()]


def header(shape, chunks, dtype, fill=None):
    return {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "fill_value": fill, "order": "C"}


def test_manifest_chunks_and_fill(spark, scratch):
    with open(f"{scratch}/data.bin", "wb") as f:
        f.write(b"....")
        f.write(struct.pack("<4f", 1, 2, 5, 6))
    refs = {
        "grid/.zarray": header([4, 4], [2, 2], "<f4", -999), "grid/.zattrs": {"_ARRAY_DIMENSIONS": ["lat", "lon"], "units": "K"},
        "grid/0.0": ["data.bin", 4, 16], "grid/0.1": b64(gzip.compress(struct.pack("<4f", 3, 4, 7, 8))),
        "grid/1.1": b64(zlib.compress(struct.pack("<4f", 15, 16, 13, 14))), "grid/1.0": ["gone.bin", 0, 16],
    }
    arrays, chunks = opened(spark, refs)
    cells = M.decode_chunks(chunks, arrays, base=scratch)
    whole = M.decode_chunks(chunks, arrays, base=scratch, fill_missing=True)
    got = values(M.complete_grid(whole, arrays, chunks))
    assert got == [1, 2, 3, 4, 5, 6, 7, 8, -999, -999, 15, 16, -999, -999, 13, 14]
    row = arrays.first()
    assert row["dims"] == ["lat", "lon"] and row["units"] == "K" and row["fill"] == -999.0
    window = M.decode_chunks(M.prune_chunks(chunks, arrays, {0: (0, 1), 1: (2, 3)}), arrays, base=scratch)
    assert values(window) == [3, 4, 7, 8]
    assert cells.count() == 12  # the chunk whose object is gone is left out


@pytest.mark.parametrize("dtype,data,want", [
    (">i2", struct.pack(">4h", 100, 200, -300, 400), [100, 200, -300, 400]), ("|b1", bytes([1, 0, 1, 1]), [1, 0, 1, 1]),
    ("uint8", bytes([200, 1, 255, 0]), [200, 1, 255, 0]), ("|i1", bytes([200, 1, 255, 0]), [-56, 1, -1, 0]),
    ("uint16", struct.pack("<4H", 65535, 1, 2, 3), [65535, 1, 2, 3]), ("<f2", np.array([1.5, -2, 0, 9], "<f2").tobytes(), [1.5, -2, 0, 9]),
    (">u4", struct.pack(">4I", 2**32 - 1, 1, 2, 3), [2**32 - 1, 1, 2, 3]),
])
def test_element_types(dtype, data, want):
    where, got = M._chunk_cells(data, dtype, [0, 0], [2, 2], [2, 2])
    assert list(got) == want and where.tolist() == [[0, 0, 1, 1], [0, 1, 0, 1]]


def test_edge_chunks_and_unknown_types():
    where, got = M._chunk_cells(struct.pack("<4B", 1, 2, 3, 4), "u1", [1, 1], [3, 3], [2, 2])
    assert where.tolist() == [[2], [2]] and list(got) == [1.0]
    with pytest.raises(GridError):
        M.element_type("complex64")


def test_version_3_headers_and_long_time_chunks(spark):
    v3 = {"shape": [2, 2, 2], "chunk_grid": {"configuration": {"chunk_shape": [2, 2, 2]}}, "data_type": "float32", "fill_value": None,
          "dimension_names": ["time", "y", "x"], "attributes": {"long_name": "Field", "scale_factor": 2.0}}
    arrays, chunks = opened(spark, {"f/zarr.json": v3, "f/c/0/0/0": b64(zlib.compress(struct.pack("<8f", *range(8))))})
    assert values(M.decode_chunks(chunks, arrays)) == list(range(8))  # the second step is not the first again
    row = arrays.first()
    assert row["dims"] == ["time", "y", "x"] and row["scale_factor"] == 2.0 and row["long_name"] == "Field"


def test_chunks_of_several_forms_in_one_batch(spark):
    refs = {"s/.zarray": header([], [], "<i2"), "s/0": b64(struct.pack("<h", 7)),
            "e/.zarray": header([3, 3], [2, 2], "|u1"), "e/0.0": b64(bytes([1, 2, 3, 4])), "e/1.1": b64(bytes([5, 6, 7, 8])), "e/0.1": b64(bytes([9])),
            "f/.zarray": header([4], [2], ">f8"), "f/1": b64(gzip.compress(struct.pack(">2d", 0.5, NAN)))}
    arrays, chunks = opened(spark, refs)
    got = {(r["variable"], r["r"], r["c"]): r["raw"] for r in M.decode_chunks(chunks, arrays).collect()}
    assert got.pop(("f", 0, 3)) != 0.0
    assert got == {("e", 0, 0): 1, ("e", 0, 1): 2, ("e", 1, 0): 3, ("e", 1, 1): 4, ("e", 2, 2): 5, ("e", 0, 2): 9, ("s", 0, 0): 7, ("f", 0, 2): 0.5}


def test_packed_manifests_read_like_files(spark, scratch):
    rows = [(f"o{i}", n, json.dumps({"refs": {f"v{n}/.zarray": header([1], [1], "|u1"), f"v{n}/0": b64(bytes([i + n]))}})) for i in range(9) for n in range(2)]
    docs = spark.createDataFrame(rows, "object STRING, shard INT, text STRING").coalesce(2)
    M.write_manifests(docs, scratch + "/files")
    M.write_manifests(docs, scratch + "/packed", packed=True)
    same = []
    for arrays, refs in (M.read_manifest(spark, scratch + "/files/object=*/shard=*/*"), M.read_manifest(spark, scratch + "/packed", packed=True)):
        cells = M.decode_chunks(M.chunk_index(refs, arrays), arrays).withColumn("manifest", F.regexp_extract("manifest", "(o[0-9])$", 1))
        same.append(sorted(map(tuple, cells.select("manifest", "variable", "raw").collect())))
    assert same[0] == same[1] == sorted((f"o{i}", f"v{n}", float(i + n)) for i in range(9) for n in range(2))
    assert len(list(Path(scratch + "/packed").glob("*.parquet"))) <= 2


def test_further_axes_go_to_extra(spark):
    arrays, chunks = opened(spark, {"v/.zarray": header([1, 1, 2, 1, 2], [1, 1, 2, 1, 2], "|u1"), "v/.zattrs": {"_ARRAY_DIMENSIONS": ["time", "lev", "kernel", "y", "x"]}, "v/0.0.0.0.0": b64(bytes([1, 2, 3, 4]))})
    rows = M.decode_chunks(chunks, arrays).collect()
    assert {(r["extra"]["kernel"], r["c"], r["raw"]) for r in rows} == {(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)}


def test_written_manifest_documents(spark, monkeypatch, scratch):
    monkeypatch.setattr(M, "SHARD_ENTRIES", 4)
    idx = spark.createDataFrame([("o", i, i, 10 * (i - 1), 10, "", []) for i in range(1, 6)], "object STRING, line BIGINT, ordinal BIGINT, offset BIGINT, length BIGINT, raw STRING, fields ARRAY<STRING>")
    heads = spark.createDataFrame(
        [("o", 10 * (i - 1), i * 10 + p, 10 if i != 4 else 9, "d", 0, 0, 0, 1, 2, bytearray([0, 1])) for i in (1, 2, 4, 5) for p in range(2 if i == 2 else 1)],
        "object STRING, offset BIGINT, seq INT, message_length INT, description STRING, discipline INT, grid_template INT, product_template INT, category INT, number INT, payload BINARY")
    entries, notes = M.build_manifest(idx, heads)
    assert entries.count() == 12 and [r["line"] for r in notes.orderBy("line").collect()] == [3, 4]
    M.write_manifests(M.manifest_documents(entries, notes), scratch + "/out")
    docs = [json.loads(r["value"]) for r in spark.read.text(scratch + "/out/*/*", wholetext=True).collect()]
    # four entries hold one whole message
    assert len(docs) == 4 and all(d["version"] == 1 for d in docs)
    for d in docs:
        names = {k.split("/")[0] for k in d["refs"] if "/" in k}
        assert all({f"{n}/.zarray", f"{n}/.zattrs", f"{n}/0"} <= set(d["refs"]) for n in names)
    assert sum(len(d["refs"][".zattrs"]["diagnostics"]) for d in docs) == 2
    refs = {k: v for d in docs for k, v in d["refs"].items()}
    assert refs["grib2_message_0002_submessage_0001/0"] == ["o", 10, 10]
    assert refs["grib2_message_0001/.zattrs"]["grib2_product_definition_hex"] == "0001"
    with pytest.raises(GridError, match="line 3"):
        M.build_manifest(idx, heads, strict=True)


def test_plane_files_and_names(spark, scratch):
    df = plane(spark, [1, 2, 3, 4], 2)
    G.write_planes(df, scratch + "/p")
    assert spark.read.parquet(scratch + "/p").filter("t = 0 AND z = 0").count() == 4
    assert G.with_plane_name(df).first()["plane_name"] == "dataset_1_x_t0000_z0000"
    vars_ = spark.createDataFrame([(1, "x", "K", "Long", None)], "dataset_id INT, variable STRING, units STRING, long_name STRING, standard_name STRING")
    meta = G.plane_metadata(df, vars_)
    G.write_metadata(meta, scratch + "/m")
    row = spark.read.json(scratch + "/m").first()
    assert row["limits"] == [1.0, 4.0] and row["units"] == "K" and row["scale"] == "linear"


# --- streams --------------------------------------------------------------------------------


def arrival(d, label, error=None, units="K"):
    dims = [("time", 1, "time"), ("lat", 2, "latitude"), ("lon", 2, "longitude")]
    return (d, 0, "temperature", dims, True, units, None, None, "netcdf4", f"f{d}.nc", [label], error)


def test_collection_grows_and_survives_a_replay(spark, scratch):
    source, sink = scratch + "/in", scratch + "/out"
    def arrive(*rows):
        spark.createDataFrame(list(rows), L.ARRIVALS).coalesce(1).write.mode("append").parquet(source)
        q = L.stream_collection(spark, source, sink, available_now=True)
        q.awaitTermination()
        assert q.exception() is None
    arrive(arrival(0, "2026-01-02T00:00:00Z"), arrival(1, "x", "truncated"))
    assert [r["dataset_id"] for r in L.latest(spark, sink, "timeline").collect()] == [0]
    arrive(arrival(2, "2026-01-01T00:00:00Z", units="C"))
    line = L.latest(spark, sink, "timeline").orderBy("t_global").collect()
    assert [r["dataset_id"] for r in line] == [2, 0]
    notes = sorted(r["message"] for r in L.latest(spark, sink, "diagnostics").collect())
    assert notes[0] == "f1.nc: truncated" and "units" in notes[1]
    assert tuple(L.latest(spark, sink, "progress").first()) == (2, 3)
    # the same batch again leaves the same tables
    again = spark.createDataFrame([arrival(2, "2026-01-01T00:00:00Z", units="C")], L.ARRIVALS)
    L.update_collection(None, sink)(again, 1)
    assert L.latest(spark, sink, "timeline").count() == 2


def test_growth_restarts_at_an_earlier_dataset_and_repeats_labels(spark, scratch):
    source, sink = scratch + "/in", scratch + "/out"

    def arrive(*rows):
        spark.createDataFrame(list(rows), L.ARRIVALS).coalesce(1).write.mode("append").parquet(source)
        q = L.stream_collection(spark, source, sink, available_now=True)
        q.awaitTermination()
        assert q.exception() is None

    arrive(arrival(5, "2026-01-05T00:00:00Z", units="K"))
    arrive(arrival(7, "2026-01-05T00:00:00Z", units="C"))
    told = sorted(r["message"] for r in L.latest(spark, sink, "diagnostics").collect())
    assert told == ["temperature: sources 5 and 7 disagree on units", 'temperature: step 0 of source 7 repeats the label "2026-01-05T00:00:00Z" of step 0 of source 5']
    # dataset 2 comes before the reference: all others are compared with it now
    arrive(arrival(2, "2026-01-01T00:00:00Z", units="C"))
    told = sorted(r["message"] for r in L.latest(spark, sink, "diagnostics").collect())
    assert told[0] == "temperature: sources 2 and 5 disagree on units" and len(told) == 2
    assert [r["dataset_id"] for r in L.latest(spark, sink, "timeline").orderBy("t_global").collect()] == [2, 5, 7]
    # a batch writes its own frames only
    assert spark.read.parquet(sink + "/frames").groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 1), (1, 1), (2, 1)]
    with pytest.raises(GridError, match="unknown table"):
        L.latest(spark, sink, "nothing")


def test_formulas_of_a_growing_collection(spark, scratch):
    """A free formula, and one pinned to a dataset that arrives last: then all datasets get it."""
    source, sink = scratch + "/in", scratch + "/out"
    formulas = [
        Derived("twice", (ref("temperature"),), lambda a: a * 2), Derived("anomaly", (ref("temperature"), ref("temperature", 9)), lambda a, b: a - b),
    ]
    for d in (1, 3, 9):
        spark.createDataFrame([arrival(d, f"2026-01-0{d}T00:00:00Z")], L.ARRIVALS).coalesce(1).write.mode("append").parquet(source)
        q = L.stream_collection(spark, source, sink, formulas, available_now=True)
        q.awaitTermination()
        assert q.exception() is None
        line = L.latest(spark, sink, "timeline")
        got = {v: [r["dataset_id"] for r in line.filter(F.col("variable") == v).orderBy("t_global").collect()] for v in ("twice", "anomaly")}
        seen = [x for x in (1, 3, 9) if x <= d]
        assert got == {"twice": seen, "anomaly": seen if d == 9 else []}
    assert {r["label"] for r in line.filter("variable = 'twice' AND dataset_id = 3").collect()} == {"2026-01-03T00:00:00Z"}


def test_snapshots_of_statistics(spark, scratch):
    source, sink = scratch + "/cells", scratch + "/stats"
    attrs = spark.createDataFrame([(1, "x", None, None, None, None, None, None)], "dataset_id INT, variable STRING, fill DOUBLE, missing DOUBLE, valid_min DOUBLE, valid_max DOUBLE, scale_factor DOUBLE, add_offset DOUBLE")
    schema = "dataset_id INT, variable STRING, t INT, z INT, r INT, c INT, raw DOUBLE"
    for i in range(5):
        spark.createDataFrame([(1, "x", i % 2, 0, i, 0, float(i)), (1, "x", 7, 0, i, 0, 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = L.start_stats(L.stream_stats(stream, attrs), sink, available_now=True, snapshot_every=2)
        q.awaitTermination()
        assert q.exception() is None
        got = {r["t"]: (r["min"], r["max"], r["finite_count"]) for r in L.latest_stats(spark, sink).collect()}
        even, odd = range(0, i + 1, 2), range(1, i + 1, 2)
        want = {t: (float(min(v)), float(max(v)), len(v)) for t, v in ((0, even), (1, odd)) if len(v)} | {7: (1.0, 1.0, i + 1)}
        assert got == want
    assert L._folders(spark, sink + "/snapshots", "upto") == [1, 3]


# --- files ----------------------------------------------------------------------------------


def test_folders_are_datasets_even_without_rows(spark, scratch):
    from gridspark.sources.grid import read_grids

    for name, n in (("b1", 6), ("b2", 0), ("a", 4)):
        spark.range(n).select(F.col("id").cast("int").alias("r"), F.lit(9).alias("dataset_id")).repartition(3).write.parquet(f"{scratch}/{name}")
    cells, datasets = read_grids(spark, [scratch + "/b?", scratch + "/*"])
    assert {r["dataset_id"]: r["path"].rsplit("/", 1)[1] for r in datasets.collect()} == {1: "b1", 2: "b2", 3: "a"}
    assert {r["dataset_id"]: r["count"] for r in cells.groupBy("dataset_id").count().collect()} == {1: 6, 3: 4}


def test_lines_of_split_files_are_numbered_in_place(spark, scratch):
    from gridspark.sources.text import numbered_lines

    want = {}
    for name, n in (("a", 400), ("b", 1), ("c", 0)):
        with open(f"{scratch}/{name}.idx", "w") as f:
            f.writelines(f"line {i} of {name}\n" for i in range(1, n + 1))
        want |= {(name, i): f"line {i} of {name}" for i in range(1, n + 1)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    try:
        rows = numbered_lines(spark, scratch + "/*.idx")
        assert {(r["path"][-5], r["line"]): r["text"] for r in rows.collect()} == want
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_chunk_source_plans_only_what_filters_touch(spark, monkeypatch, scratch):
    from pyspark.sql import datasource as D

    from gridspark.sources import chunks as S

    monkeypatch.setattr(S, "TASK_CHUNKS", 20)
    head = '"x/.zarray":{"zarr_format":2,"shape":[40,6,10],"chunks":[1,6,4],"dtype":"<i2","fill_value":-5,"compressor":null,"order":"C","filters":null},"x/.zattrs":{"_ARRAY_DIMENSIONS":["t","r","c"]}'
    size = 6 * 4 * 2
    body = np.arange(40 * 3 * 24, dtype="<i2").reshape(40, 3, 24)
    with open(scratch + "/data.bin", "wb") as f:
        f.write(body.tobytes())
    refs = [f'"x/{t}.0.{c}":["data.bin",{(t * 3 + c) * size},{size}]' for t in range(40) for c in range(3)] + ['"x/39.0.9":["gone.bin",0,48]']
    docs = spark.createDataFrame([("m", '{"refs":{' + ",".join([head, *refs]) + "}}")], "manifest STRING, text STRING")
    arrays, found = M.open_manifests(docs)
    S.write_chunk_index(M.chunk_index(found, arrays), arrays, scratch + "/index")
    cells = S.read_chunks(spark, scratch + "/index", base=scratch)
    whole = M.decode_chunks(M.chunk_index(found, arrays), arrays, base=scratch)
    same = lambda df: sorted(map(tuple, df.select("manifest", "variable", "t", "z", "r", "c", "raw").collect()))
    assert same(cells) == same(whole) and cells.count() == 40 * 6 * 10
    test = "t BETWEEN 3 AND 5 AND c >= 8 AND variable = 'x'"
    assert same(cells.filter(test)) == same(whole.filter(test))
    assert cells.filter("variable = 'y'").count() == 0 and cells.filter("t IN (1, 39)").count() == 120

    def planned(*filters):
        reader = S.ChunkReader({"path": scratch + "/index", "base": scratch})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return reader.partitions(), reader

    everything, _ = planned()
    some, reader = planned(D.GreaterThanOrEqual(("t",), 3), D.LessThan(("t",), 6), D.GreaterThanOrEqual(("c",), 8))
    rows = lambda pieces: sum(pq.ParquetFile(p.file).metadata.row_group(g).num_rows for p in pieces for g in p.groups)
    assert rows(some) < rows(everything) == 121
    assert sum(len(b) for p in some for b in reader.read(p)) == 3 * 6 * 2  # three steps, the last block of two columns
    none, _ = planned(D.EqualTo(("variable",), "y"))
    assert [p.groups for p in none] == [[]]


def test_aerosol_units_by_value_or_by_scale(spark):
    # scale 7, 20,000 and missing; scale 9, 2,000,000; scale 2, 5
    payload = "0000" + "0030" + "0d00" + "f251" + "02" + "0700004e20" + "0780000000" + "07" + "09001e8480" + "0200000005"
    df = spark.createDataFrame([(48, bytearray.fromhex(payload))], "product_template INT, payload BINARY")
    names = ["size1", "size2", "wavelength1", "wavelength2"]
    by_value, by_scale = (list(X.aerosol(df, unit_by_scale=s).select(names).first()) for s in (False, True))
    assert by_value == ["interval=2;0.002m", "interval=2;missing", "interval=7;0.002m", "interval=7;0.05m"]
    assert by_scale == ["interval=2;2000um", "interval=2;missing", "interval=7;2000000nm", "interval=7;0.05m"]


def test_a_file_of_many_arrivals_is_more_than_one_task(spark, scratch, monkeypatch):
    monkeypatch.setattr(L, "ROWS_PER_TASK", 10, raising=False)
    dims = [("time", 1, "time"), ("lat", 4, "latitude"), ("lon", 8, "longitude")]
    rows = [(d, 0, v, dims, True, "K" if d == 7 else "m", v, None, "netcdf4", f"f{d}", [f"t={d}"], None) for d in range(60) for v in ("a", "b")]
    batch = spark.createDataFrame(rows, L.ARRIVALS).coalesce(1)
    L.update_collection(None, scratch)(batch, 0)
    assert len(list(Path(scratch + "/arrivals/batch_id=0").glob("*.parquet"))) == 4  # as many as shuffle partitions
    assert len(list(Path(scratch + "/frames/batch_id=0").glob("*.parquet"))) > 1
    line = L.latest(spark, scratch, "timeline").filter("variable = 'a'").orderBy("t_global").collect()
    assert [(r["t_global"], r["dataset_id"], r["label"]) for r in line] == [(i, d, f"t={d}") for i, d in enumerate(range(60))]
    notes = sorted((r["variable"], r["dataset_id"]) for r in L.latest(spark, scratch, "diagnostics").collect())
    assert notes == [("a", 7), ("b", 7)]


def test_frames_and_differences_of_a_batch_come_from_its_rows(spark, scratch):
    """As from the catalogue's tables, but no arrival is shuffled for its dimensions, labels, path or first dataset."""
    def dims(time, x):
        return [("time", time, "time"), (x, 4, "latitude"), ("lon", 8, "longitude")]

    def row(d, v, ds, labels, units="K"):
        return (d, 0, v, ds, True, units, v, None, "netcdf3" if d == 5 else "netcdf4", f"f{d}", labels, None)

    rows = [row(d, v, dims(d % 3 + 1, "lat"), [f"t={d}"] * 2, "m" if d == 7 else "K") for d in range(1, 400) for v in ("a", "b")]
    rows += [
        row(0, "a", dims(1, "lat"), None), row(0, "b", dims(1, "y"), ["x", None]),
        # dimensions that the first a lacks, but not its dataset; those that both lack; one name twice; none at all
        row(400, "a", dims(2, "y"), ["p", None]), row(401, "a", dims(2, "z"), []),
        row(402, "a", [("time", 1, "time"), ("n", 3, None), ("n", 3, None)], ["q"]), row(403, "a", None, ["r", "s"]),
    ]
    batch = spark.createDataFrame(rows, L.ARRIVALS).coalesce(1)
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled():
        stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    L.update_collection(None, scratch)(batch, 0)
    assert shuffled() - before < len(rows) // 2
    gs, labels = L.catalogue(batch)
    for table, want in (("frames", K.frames(gs, labels)), ("differences", K.differences(gs))):
        got = spark.read.parquet(f"{scratch}/{table}").drop("batch_id")
        want = sorted(want.select(*got.columns).collect(), key=str)
        assert sorted(got.collect(), key=str) == want and want
    notes = {r["dataset_id"]: r["message"] for r in spark.read.parquet(scratch + "/differences").filter("variable = 'a'").collect()}
    assert notes[400].endswith("on dimensions") and notes[401].endswith("on dimensions, dimension shapes or roles")
