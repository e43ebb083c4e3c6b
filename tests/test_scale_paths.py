"""The paths taken for large inputs, forced on small ones and compared with brute force."""

import random
from itertools import groupby
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import scalars as S
from gridspark.operators import binning as B
from gridspark.operators import distribution as H
from gridspark.operators import ordered as O
from gridspark.operators import polygons as Y
from gridspark.operators import ranges as R
from gridspark.operators import spatial as N
from gridspark.sources import text as X


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 5)


def hot_rows(spark, n=60):
    """A third of the rows in one group, many small groups, repeated order values."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", i // 2, i, float(rng.randint(1, 9))) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g STRING, o INT, id INT, v DOUBLE").repartition(3)


def test_row_numbers_neighbours_and_sums(spark, tiny_blocks):
    rows, df = hot_rows(spark)
    want = {}
    for _, members in groupby(sorted(rows, key=lambda r: (r[0], r[1], r[2])), key=lambda r: r[0]):
        members, total = list(members), 0.0
        for i, m in enumerate(members):
            total += m[3]
            want[m[2]] = (i + 1, members[i - 1][2] if i else None, members[i + 1][2] if i + 1 < len(members) else None, total)
    order = [F.col("o"), F.col("id")]
    got = {r["id"]: r["n"] for r in O.number_rows(df, ["g"], order, "n").collect()}
    assert got == {k: w[0] for k, w in want.items()}
    near = O.with_neighbours(df, ["g"], order, {"id": "p"}, {"id": "f"}).collect()
    assert {r["id"]: (r["p"], r["f"]) for r in near} == {k: w[1:3] for k, w in want.items()} and len(near) == len(rows)
    sums = O.running_sum(df, ["g"], order, "v", "s").collect()
    assert {r["id"]: r["s"] for r in sums} == {k: w[3] for k, w in want.items()}
    dense = [r["_g"] for r in O.dense_order(df, F.col("id")).orderBy("id").collect()]
    assert dense == list(range(len(rows)))


def test_order_with_nulls_and_descending_keys(spark, tiny_blocks):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 5) for i in range(40)], "id INT, k INT")
    got = O.number_rows(df, [], [F.col("k").desc_nulls_last(), F.col("id")], "n").orderBy("n").collect()
    want = sorted(((r.id, r.k) for r in df.collect()), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["id"], r["k"]) for r in got] == want and [r["n"] for r in got] == list(range(1, 41))


def test_cdf_in_blocks_with_long_ties(spark, tiny_blocks, monkeypatch):
    monkeypatch.setattr(H, "_RUN", 4)
    values = [1.0] * 30 + [2.0] * 3 + [float(i) for i in range(3, 20)] + [-0.5]
    df = spark.createDataFrame([("a", v, "Finite") for v in values] + [("a", 7.0, "Fill"), ("a", float("nan"), "Finite")], "k STRING, value DOUBLE, validity STRING")
    got = H.cdf(df, ["k"]).orderBy("rank").collect()
    assert [r["value"] for r in got] == sorted(values)
    assert [r["percent"] for r in got] == [(i + 1) * 100.0 / len(values) for i in range(len(values))]
    assert len(H.cdf(df, []).collect()) == len(values)


def fold(rows, cap):
    out = []
    for s, e in sorted(rows):
        if out and out[-1][1] == s and e - out[-1][0] <= cap:
            out[-1][1] = e
        else:
            out.append([s, e])
    return sorted(map(tuple, out))


def random_ranges(seed, n=80):
    rng, at, rows = random.Random(seed), 0, []
    for _ in range(n):
        if rng.random() < 0.1:
            at += rng.randint(1, 5)
        size = rng.choice([0, 1, 2, 3, 5, 9, 30])
        rows.append((at, at + size))
        at += size
    return rows


@pytest.mark.parametrize("seed,cap,chain,piece", [(1, 10, 50_000, 256), (1, 10, 50_000, 4), (1, 10, 3, 1), (2, 6, 2, 3), (3, 1, 1, 256), (4, 1000, 1, 2)])
def test_range_merging_equals_the_sequential_fold(spark, monkeypatch, seed, cap, chain, piece):
    monkeypatch.setattr(R, "CHAIN_ROWS", chain)
    monkeypatch.setattr(R, "PIECE", piece)
    a, b = random_ranges(seed), random_ranges(seed + 50, 25)
    df = spark.createDataFrame([("a", *r) for r in a] + [("b", *r) for r in b], "object STRING, start BIGINT, end BIGINT").repartition(3)
    got = R.coalesce_ranges(df, cap).collect()
    for name, rows in (("a", a), ("b", b)):
        assert sorted((r["start"], r["end"]) for r in got if r["object"] == name) == fold(rows, cap)


def test_range_examples(spark):
    df = spark.createDataFrame([("o", 0, 2), ("o", 8, 9), ("o", 2, 5)], "object STRING, start BIGINT, end BIGINT")
    assert sorted((r["start"], r["end"]) for r in R.coalesce_ranges(df, 6).collect()) == [(0, 5), (8, 9)]
    with pytest.raises(Exception, match="zero"):
        R.coalesce_ranges(df, 0)
    bad = spark.createDataFrame([("o", 0, 10), ("o", 4, 3), ("o", 4, 11), ("p", 0, 1)], "object STRING, start BIGINT, end BIGINT")
    found = R.validate_ranges(bad, spark.createDataFrame([("o", 10)], "object STRING, size BIGINT")).collect()
    assert sorted((r["object"], r["start"], r["end"]) for r in found) == [("o", 4, 3), ("o", 4, 11), ("p", 0, 1)]


# --- nearest joins -------------------------------------------------------------------


def clustered(rng, n):
    """Half of the points in one tiny cluster, copies included; the rest everywhere."""
    dense = np.column_stack([10 + rng.random(n // 2) * 1e-4, 20 + rng.random(n // 2) * 1e-4])
    dense[: n // 8] = dense[0]
    wide = np.column_stack([rng.uniform(-90, 90, n - n // 2), rng.uniform(-180, 180, n - n // 2)])
    return np.vstack([dense, wide])


def xyz(p):
    la, lo = np.radians(p[:, 0]), np.radians(p[:, 1])
    return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


@pytest.mark.parametrize("places,limit,rows", [(4096, 256, 5_000), (60, 64, 0), (6, 24, 0)])
def test_nearest_cell_equals_brute_force(spark, monkeypatch, places, limit, rows):
    """Lists for all queries, for some, and nearly all queries searched one by one; with and without a broadcast."""
    monkeypatch.setattr(N, "BLOCK_PLACES", places)
    monkeypatch.setattr(N, "CANDIDATES", limit)
    join = N.lookup_join
    monkeypatch.setattr(N, "lookup_join", lambda a, b, on, how="left", max_rows=0: join(a, b, on, how, rows))
    rng = np.random.default_rng(5)
    src = clustered(rng, 160)
    ask = np.vstack([clustered(rng, 60), [[90.0, 180.0], [-90.0, -180.0], [0.0, 179.99], [5.0, 360.0]]])
    grid = spark.createDataFrame(
        [(i // 16, i % 16, float(a), float(b)) for i, (a, b) in enumerate(src)] + [(99, 0, float("nan"), 0.0)], "r INT, c INT, lat DOUBLE, lon DOUBLE"
    )
    q = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ask)] + [(1000, float("nan"), 0.0)], "id INT, lat DOUBLE, lon DOUBLE")
    got = {r["id"]: (r["src_r"], r["src_c"]) for r in N.nearest_cell(q, grid).collect()}
    assert got.pop(1000) == (None, None) and len(got) == len(ask)
    for i, (la, lo) in enumerate(ask):
        lo = (lo + 180) % 360 - 180
        d = np.min([(src[:, 0] - la) ** 2 + (src[:, 1] + k - lo) ** 2 for k in (-360.0, 0.0, 360.0)], axis=0)
        best = np.flatnonzero(d == d.min())[0]
        r, c = got[i]
        assert d[r * 16 + c] == pytest.approx(d.min(), abs=1e-18), i
        if len(np.flatnonzero(np.isclose(d, d.min(), rtol=1e-12, atol=0))) == 1:
            assert (r, c) == (best // 16, best % 16)


def test_blocks_follow_the_queries(spark):
    """Of 10,000 points all over the globe, five queries in one corner touch a few cells only."""
    rng = np.random.default_rng(3)
    wide = np.column_stack([rng.uniform(-90, 90, 10_000), rng.uniform(-180, 180, 10_000)])
    points = spark.createDataFrame([(float(a), float(b), 1) for a, b in wide], "x0 DOUBLE, x1 DOUBLE, n BIGINT")
    depth = N._depth(10_000, N.DEGREES)
    h = N.DEGREES.size / 2**depth
    asked = spark.createDataFrame([(int((50.0 + i / 10 + 1024) // h), int((7.0 + 1024) // h)) for i in range(5)], "q0 BIGINT, q1 BIGINT")
    found, blocks, _ = N.homes(asked.distinct(), points, N.DEGREES, 1)
    assert found.count() == asked.distinct().count()
    per_block = blocks.groupBy("level", "h0", "h1").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total")).collect()
    assert len(per_block) <= 5 and all(r["n"] <= 9 and 1 <= r["total"] <= 300 for r in per_block)


def test_far_queries_share_split_blocks(spark, monkeypatch):
    """A dense line seen from afar: lists are shared by cells of queries and never broadcast."""
    rng = random.Random(5)
    grid_rows = [(r, c, -30.0 + 60.0 * r, -60.0 + 0.1 * c) for r in range(2) for c in range(1200)]
    grid = spark.createDataFrame(grid_rows, "r INT, c INT, lat DOUBLE, lon DOUBLE")
    asked = [(i, rng.uniform(-25, 25), rng.uniform(-60, 59)) for i in range(300)]
    q = spark.createDataFrame(asked, "id INT, lat DOUBLE, lon DOUBLE")
    monkeypatch.setattr(N, "BLOCK_PLACES", 500)
    one_by_one, broadcast = [], []
    search, join = N._search_each, N.lookup_join
    monkeypatch.setattr(N, "_search_each", lambda *a: one_by_one.append(1) or search(*a))
    monkeypatch.setattr(N, "lookup_join", lambda big, small, *a, **b: broadcast.append("_cands" in small.columns) or join(big, small, *a, **b))
    got = {r["id"]: (r["src_r"], r["src_c"]) for r in N.nearest_cell(q, grid).collect()}
    for i, lat, lon in asked:
        assert got[i] == min(((y - lat) ** 2 + (x - lon) ** 2, r, c) for r, c, y, x in grid_rows)[1:]
    assert one_by_one == [] and not any(broadcast)


def test_nearest_tie_takes_the_lowest_cell(spark):
    grid = spark.createDataFrame([(0, 0, 0.0, -1.0), (0, 1, 0.0, 1.0)], "r INT, c INT, lat DOUBLE, lon DOUBLE")
    q = spark.createDataFrame([(0.0, 0.0), (0.0, 180.0)], "lat DOUBLE, lon DOUBLE")
    assert [(r["src_r"], r["src_c"]) for r in N.nearest_cell(q, grid).collect()] == [(0, 0), (0, 0)]
    assert N.nearest_cell(q, grid.filter("r > 5")).filter("src_r IS NULL").count() == 2


@pytest.mark.parametrize("places,limit", [(4096, 256), (40, 48)])
def test_nearest_mesh_and_reach_equal_brute_force(spark, monkeypatch, places, limit):
    monkeypatch.setattr(N, "BLOCK_PLACES", places)
    monkeypatch.setattr(N, "CANDIDATES", limit)
    rng = np.random.default_rng(8)
    pts, ask = clustered(rng, 120), clustered(rng, 50)
    mesh = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "dataset_id INT, m INT, lat DOUBLE, lon DOUBLE")
    d = ((xyz(pts)[:, None, :] - xyz(pts)[None, :, :]) ** 2).sum(axis=2)
    reach = np.sort(d, axis=1)[:, 3].max()
    assert N.mesh_reach(mesh).first()["reach2"] == pytest.approx(reach, rel=1e-9)
    q = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ask)], "id INT, lat DOUBLE, lon DOUBLE")
    e = ((xyz(ask)[:, None, :] - xyz(pts)[None, :, :]) ** 2).sum(axis=2)
    for r in N.nearest_mesh(q, mesh).collect():
        assert r["d2"] == pytest.approx(e[r["id"]].min(), abs=1e-15)
        assert e[r["id"], r["m"]] == pytest.approx(e[r["id"]].min(), abs=1e-15)
    near = N.nearest_mesh(q, mesh, reach2=1e-6).collect()
    assert {r["id"] for r in near if r["m"] is not None} == {i for i in range(len(ask)) if e[i].min() <= 1e-6}


def test_reach_of_few_points(spark):
    schema = "dataset_id INT, m INT, lat DOUBLE, lon DOUBLE"
    assert N.mesh_reach(spark.createDataFrame([(1, 0, 0.0, 0.0)], schema)).first()["reach2"] == float("inf")
    two = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 90.0)], schema)
    assert N.mesh_reach(two).first()["reach2"] == pytest.approx(2.0)


def test_regrid(spark):
    mesh = spark.createDataFrame(
        [(1, i, la, lo) for i, (la, lo) in enumerate([(45.0, -90.0), (45.0, 90.0), (-45.0, -90.0), (-45.0, 90.0)])],
        "dataset_id INT, m INT, lat DOUBLE, lon DOUBLE",
    )
    values = spark.createDataFrame([(1, "q2", t, 0, m, float(4 * t + m)) for t in (0, 1) for m in range(4)], "dataset_id INT, variable STRING, t INT, z INT, m INT, raw DOUBLE")
    out = N.regrid(values, mesh, 30.0).cache()
    second = out.filter("t = 1").agg(F.min("value"), F.max("value"), F.count("*")).first()
    assert tuple(second) == (4.0, 7.0, 72)
    # one point only reaches itself when the reach is small; far cells are NaN, not Missing
    near = spark.createDataFrame([(1, i, 0.0, i * 0.1) for i in range(5)], mesh.schema)
    far = N.regrid(values, near, 90.0)
    assert {r["validity"] for r in far.select("validity").distinct().collect()} == {"NaN"}
    assert N.grid_shape(0.25) == (720, 1440) and N.refinement(24, 648, 10.0) == 5 and N.refinement(10**9, 648, 10.0) == 1
    assert N.refinement(1, 10**9, 0.05) == 5
    with pytest.raises(Exception):
        N.grid_shape(0.0)


# --- polygons --------------------------------------------------------------------------


def ring(i, pts, polygon=None):
    return (f"r{i}", polygon or f"p{i}", [(float(a), float(b)) for a, b in pts])


RINGS = [
    ring(0, [(179, -1), (-179, -1), (-179, 1), (179, 1)]),
    ring(1, [(0, 0), (10, 0), (10, 10), (0, 10)], "box"),
    ring(2, [(3, 3), (6, 3), (6, 6), (3, 6)], "box"),
]
SCHEMA = "ring_id STRING, polygon_id STRING, points ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>"
SPOTS = [(0.0, 179.8, True, True), (0.0, -179.8, True, True), (0.0, 170.0, False, False), (1.0, 1.0, True, True), (4.0, 4.0, True, False), (11.0, 1.0, False, False)]


@pytest.mark.parametrize("limit", [Y.BROADCAST_EDGES, 0])
def test_points_in_rings(spark, monkeypatch, limit):
    monkeypatch.setattr(Y, "BROADCAST_EDGES", limit)
    rings = spark.createDataFrame(RINGS, SCHEMA)
    pts = spark.createDataFrame([(i, la, lo) for i, (la, lo, _, _) in enumerate(SPOTS)], "id INT, lat DOUBLE, lon DOUBLE")
    for holes in (False, True):
        got = {r["id"]: r["inside"] for r in Y.in_polygons(pts, rings, ["id"], holes).collect()}
        assert got == {i: s[3 if holes else 2] for i, s in enumerate(SPOTS)}


@pytest.mark.parametrize("most,limit", [(256, 100_000), (2, 0)])
def test_star_polygons_equal_brute_force(spark, monkeypatch, most, limit):
    """Jagged rings, one across the date line, one half the globe wide; bins of few and of many bands."""
    monkeypatch.setattr(Y, "BAND_EDGES", most)
    monkeypatch.setattr(Y, "BROADCAST_EDGES", limit)
    rng = np.random.default_rng(4)
    stars = []
    for i, (x, y, size) in enumerate([(0, 0, 20), (5, 5, 8), (-100, 40, 30), (60, -70, 12), (2, 1, 3)]):
        turn = np.sort(rng.uniform(0, 2 * np.pi, 60))
        far = rng.uniform(0.3, 1, 60) * size
        stars.append((f"s{i}", f"p{i % 3}", [(float(x + a), float(y + b)) for a, b in zip(far * np.cos(turn), far * np.sin(turn))]))
    wide = ("wide", "p9", [(-120.0, -85.0), (0.0, -88.0), (120.0, -85.0), (120.0, -80.0), (0.0, -75.0), (-120.0, -80.0)])
    seam = ("seam", "p8", [(175.0, 60.0), (-170.0, 60.0), (-172.0, 66.0), (178.0, 70.0)])
    spots = np.vstack([rng.uniform([-90, -180], [90, 180], (400, 2)), rng.uniform([-20, -20], [20, 20], (400, 2)), rng.uniform([58, 170], [72, 180], (60, 2)), rng.uniform([58, -180], [72, -165], (60, 2))])

    def odd(pts, lat, lon):
        x0 = pts[0][0]
        near = lambda x: x - 360 * round((x - x0) / 360) if abs(x - x0) > 180 else x
        px, n = near(lon), 0
        for (ax, ay), (bx, by) in zip(pts, [pts[-1], *pts[:-1]]):
            if (ay > lat) != (by > lat) and px < (near(bx) - near(ax)) * (lat - ay) / (by - ay) + near(ax):
                n += 1
        return n % 2 == 1

    every = [*stars, wide, seam]
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(spots)], "id INT, lat DOUBLE, lon DOUBLE")
    for holes in (False, True):
        got = {r["id"]: r["inside"] for r in Y.in_polygons(pts, spark.createDataFrame(every, SCHEMA), ["id"], holes).collect()}
        for i, (lat, lon) in enumerate(spots):
            hits = [pid for _, pid, ring_pts in every if odd(ring_pts, lat, lon)]
            want = any(hits.count(p) % 2 for p in hits) if holes else bool(hits)
            assert got[i] == want, (lat, lon, hits)


def _inside(spots, rings, holes):
    """Brute force: is a (lat, lon) in any ring, or with holes in any polygon?"""

    def odd(pts, lat, lon):
        x0 = pts[0][0]
        near = lambda x: x - 360 * round((x - x0) / 360) if abs(x - x0) > 180 else x
        px, n = near(lon), 0
        w, e = min(p[0] for p in pts), max(p[0] for p in pts)
        if e - w < 180 and not w <= lon <= e:
            return False
        for (ax, ay), (bx, by) in zip(pts, [pts[-1], *pts[:-1]]):
            if (ay > lat) != (by > lat) and px < (near(ax) - near(bx)) * (lat - ay) / (ay - by) + near(ax):
                n += 1
        return n % 2 == 1

    found = []
    for lat, lon in spots:
        hits = [pid for _, pid, pts in rings if odd(pts, lat, lon)]
        found.append(any(hits.count(p) % 2 for p in hits) if holes else bool(hits))
    return found


@pytest.mark.parametrize("limit", [Y.BROADCAST_EDGES, 0])
def test_cells_settle_places_as_single_edges_do(spark, monkeypatch, limit):
    """Rings over each other, on borders of cells, over the date line and beyond 180 degrees; places on their borders, on the poles and in 0..360."""
    monkeypatch.setattr(Y, "PLACES_PER_CELL", 0)
    monkeypatch.setattr(Y, "CELLS_OF_BIN", (2, 8))
    monkeypatch.setattr(Y, "BROADCAST_EDGES", limit)
    rng = np.random.default_rng(5)
    box = lambda w, s, e, n: [(float(x), float(y)) for x, y in ((w, s), (e, s), (e, n), (w, n))]
    rings = [
        ("a", "p0", box(-30, -20, 40, 35)), ("b", "p0", box(-5, -5, 10, 10)), ("c", "p0", box(0, 0, 2.5, 2.5)), ("d", "p1", box(-2.5, 0, 7.5, 5)),
        ("seam", "p2", box(170, 50, -165, 70)), ("beyond", "p3", box(340, -60, 365, -45)), ("polar", "p4", box(-60, 80, 60, 90)),
        ("wide", "p5", [(-120.0, -85.0), (0.0, -88.0), (120.0, -85.0), (120.0, -80.0), (0.0, -75.0), (-120.0, -80.0)]),
        ("half", "p7", [(-100.0, 20.0), (95.0, 60.0), (90.0, -30.0)]), ("flat", "p8", [(50.0, 0.0), (60.0, 0.0), (55.0, 0.0)]),
    ]
    for i, (x, y) in enumerate([(70, 0), (72, 4), (-100, 40)]):
        turn, far = np.sort(rng.uniform(0, 2 * np.pi, 40)), rng.uniform(4, 15, 40)
        rings.append((f"s{i}", f"p{i % 2}", [(float(x + a), float(y + b)) for a, b in zip(far * np.cos(turn), far * np.sin(turn))]))
    near = [(y + float(j), x + float(i)) for _, _, pts in rings[:9] for x, y in pts for i in rng.uniform(-4, 4, 4) for j in (0.0, *rng.uniform(-4, 4, 3))]
    grid = [(float(a), float(o)) for a in (-90, -85, -5, 0, 2.5, 10, 35, 89.9, 90) for o in (-180, -30, -5, 0, 2.5, 10, 40, 175, 180, 190, 195, 345, 360, 365)]
    spots = near + grid + [(float(a), float(o)) for a, o in rng.uniform([-90, -180], [90, 370], (600, 2))]
    pts = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate(spots)], "id INT, lat DOUBLE, lon DOUBLE")
    for holes in (False, True):
        got = {r["id"]: r["inside"] for r in Y.in_polygons(pts, spark.createDataFrame(rings, SCHEMA), ["id"], holes).collect()}
        assert [s for i, (s, w) in enumerate(zip(spots, _inside(spots, rings, holes))) if got[i] != w] == []


def test_places_under_many_rings_meet_few_edges(spark, monkeypatch):
    """Places times rings over them would be 400,000 pairs; cells inside a ring, and cells outside of all, need none."""
    monkeypatch.setattr(Y, "PLACES_PER_CELL", 1)
    met, meet = [], Y._meet

    def counted(few, edges):
        met.append(meet(few, edges).cache())
        return met[-1]

    monkeypatch.setattr(Y, "_meet", counted)
    rings = spark.range(200).select(
        F.concat(F.lit("r"), "id").alias("ring_id"), F.col("id").cast("string").alias("polygon_id"),
        F.array(*[F.struct((F.lit(x) + F.col("id") / 1000).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.5, 0.5), (24.5, 0.5), (24.5, 24.5), (0.5, 24.5))]).alias("points"),
    )
    pts = spark.range(4000).select("id", (F.col("id") % 61 * 0.41).alias("lat"), (F.col("id") % 67 * 0.37 + F.col("id") * 1e-6).alias("lon"))
    out = Y.in_polygons(pts, rings, ["id"], holes=True)
    wrong = out.filter(F.col("inside") != ((F.col("lat") >= 0.5) & (F.col("lat") < 24.5) & (F.col("lon") >= 0.5) & (F.col("lon") < 24.5 + 0.199)))
    assert wrong.isEmpty() and out.filter("inside").count() > 2000
    assert len(met) > 1 and met[-1].select("lat", "lon").distinct().count() < 1500


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), 1e9])
def test_a_ring_with_a_bad_vertex_leaves_the_others_right(spark, monkeypatch, bad):
    monkeypatch.setattr(Y, "PLACES_PER_CELL", 0)
    rings = spark.createDataFrame([*RINGS, ring(9, [(20, 20), (21, 20), (bad, 21)])], SCHEMA)
    pts = spark.createDataFrame([(i, la, lo) for i, (la, lo, _, _) in enumerate(SPOTS)], "id INT, lat DOUBLE, lon DOUBLE")
    got = {r["id"]: r["inside"] for r in Y.in_polygons(pts, rings, ["id"], True).collect()}
    assert got == {i: s[3] for i, s in enumerate(SPOTS)}


def test_bands_do_not_copy_tall_edges(spark, monkeypatch):
    monkeypatch.setattr(Y, "BAND_EDGES", 1)
    tall = spark.range(100).select(
        F.lit("p").alias("polygon_id"), F.col("id").alias("_ring"), F.lit("x").alias("ring_id"),
        F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((1.0, -20.0), (2.0, -20.0), (2.0, 20.0))]).alias("points"),
    )
    binned = Y.edge_bins(Y.prepare_rings(tall))
    sizes = Y._band_counts(binned)
    assert Y._banded(binned, sizes, F.least("y0", "y1"), F.greatest("y0", "y1")).count() <= 2 * binned.count()


def test_border_cells(spark):
    land = {(0, 0), (2, 3)}
    mask = spark.createDataFrame([(r, c, (r, c) in land) for r in range(4) for c in range(5)], "r INT, c INT, land BOOLEAN")
    got = {(r["r"], r["c"]) for r in Y.border_cells(mask).collect()}
    want = {(r, c) for r in range(4) for c in range(5) if (r, c) not in land and any(max(abs(r - a), abs(c - b)) == 1 for a, b in land)}
    assert got == want


def test_topology(spark):
    text = (
        '{"transform":{"scale":[1,1],"translate":[0,0]},"arcs":[[[0,0],[4,0]],[[4,0],[0,4],[-4,0],[0,-4]],[[9,9],[1,0],[0,1]]],'
        '"objects":{"land":{"geometries":[{"type":"MultiPolygon","arcs":[[[0,1]],[[-2,-1]]]},{"type":"Polygon","arcs":[[2]]}]}}}'
    )
    rows = Y.decode_topology(spark.createDataFrame([("d", text)], "doc STRING, text STRING")).orderBy("ring_id").collect()
    pts = [[(p["lon"], p["lat"]) for p in r["points"]] for r in rows]
    assert [r["ring_id"] for r in rows] == ["0/0/0", "0/1/0", "1/0/0"]
    assert pts[0] == [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)] and pts[1] == pts[0][::-1]
    assert pts[2] == [(9, 9), (10, 9), (10, 10), (9, 9)]  # closed


def test_many_small_groups_are_not_spread(spark, tiny_blocks, monkeypatch):
    monkeypatch.setattr(O, "_spread", lambda *_: pytest.fail("spread"))
    df = spark.range(20).select((F.col("id") % 5).alias("g"), "id")
    assert {(r["id"], r["n"]) for r in O.number_rows(df, ["g"], [F.col("id")], "n").collect()} == {(i, i // 5 + 1) for i in range(20)}


def test_packed_topologies_need_no_file_each(spark, scratch):
    text = '{"transform":{"scale":[1,1],"translate":[%d,0]},"arcs":[[[9,9],[1,0],[0,1]]],"objects":{"land":{"geometries":[{"type":"Polygon","arcs":[[0]]}]}}}'
    docs = spark.createDataFrame([(f"d{i}", text % i) for i in range(50)], "doc STRING, text STRING").coalesce(2)
    docs.write.partitionBy("doc").text(scratch + "/files")
    X.write_documents(docs.withColumnRenamed("doc", "name"), scratch + "/packed")
    single = Y.read_topology(spark, scratch + "/files/doc=*").withColumn("doc", F.regexp_extract("doc", "/doc=([^/]*)/", 1))
    packed = Y.read_topology(spark, scratch + "/packed", packed=True)
    same = lambda df: sorted(map(tuple, df.select("doc", "ring_id", F.to_json("points")).collect()))
    assert same(packed) == same(single) and packed.count() == 50
    assert len(list(Path(scratch + "/packed").glob("*.parquet"))) <= 2


@pytest.mark.parametrize("block", [100_000, 2])
def test_null_groups_survive_every_size(spark, monkeypatch, block):
    monkeypatch.setattr(O, "BLOCK", block)
    rows = [(None, 1.0), (None, 2.0), ("a", 5.0), ("a", 5.0), ("b", 7.0), (None, 2.0)]
    df = spark.createDataFrame([(k, v, "Finite") for k, v in rows], "k STRING, value DOUBLE, validity STRING")
    got = O.running_sum(df.select("k", "value").distinct(), ["k"], [F.col("value")], "value", "s")
    assert sorted((r["k"] or "", r["value"], r["s"]) for r in got.collect()) == [("", 1.0, 1.0), ("", 2.0, 3.0), ("a", 5.0, 5.0), ("b", 7.0, 7.0)]
    steps = H.cdf(df, ["k"])
    assert sorted((r["k"] or "", r["value"], r["rank"]) for r in steps.collect()) == [
        ("", 1.0, 1), ("", 2.0, 2), ("", 2.0, 3), ("a", 5.0, 1), ("a", 5.0, 2), ("b", 7.0, 1)
    ]


@pytest.mark.parametrize("limit", [Y.BROADCAST_EDGES, 0])
def test_points_without_a_key_are_found(spark, monkeypatch, limit):
    monkeypatch.setattr(Y, "BROADCAST_EDGES", limit)
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rings = spark.createDataFrame([(1, 1, square)], "ring_id INT, polygon_id INT, points ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>")
    points = spark.createDataFrame([(None, 1.0, 1.0), (None, 9.0, 9.0), (7, 2.0, 2.0), (7, 2.0, 9.0), (8, None, 1.0)], "id INT, lat DOUBLE, lon DOUBLE")
    got = Y.in_polygons(points, rings, ["id"]).collect()
    assert sorted((r["id"] or 0, r["lat"] or 0.0, r["lon"], r["inside"]) for r in got) == [
        (0, 1.0, 1.0, True), (0, 9.0, 9.0, False), (7, 2.0, 2.0, True), (7, 2.0, 9.0, False), (8, 0.0, 1.0, False)
    ]


def test_constant_field_on_a_log_scale(spark):
    df = spark.createDataFrame([(1, 0.3, "Finite"), (1, 0.3, "Finite")], "k INT, value DOUBLE, validity STRING")
    assert tuple(B.limits(df, ["k"], "log").first()) == (1, 0.3, 0.3)
    assert tuple(B.limits(df, ["k"]).first()) == (1, -0.2, 0.8)


def test_origin_with_a_zone(spark):
    units = "hours since 2000-01-01 06:00:00"
    rows = spark.createDataFrame([(1.0, units), (1.0, units + " +02:00"), (1.0, units + " -1"), (1.0, units + "Z")], "v DOUBLE, u STRING")
    got = [r[0] for r in rows.select(S.decode_time(F.col("v"), F.col("u"))).collect()]
    assert [x[11:16] for x in got] == ["07:00", "05:00", "08:00", "07:00"]
