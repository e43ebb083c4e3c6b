"""Points in polygons, borders of masks and decoding of shared-arc topologies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.text import read_documents
from .joins import at_most, cut_lineage, sized_broadcast

# The candidate bins are five degrees wide.
LON_BINS, LAT_BINS = 72, 36
#: Edges of a candidate bin beyond which the bin is cut into bands of latitude, and the most bands of a bin.
BAND_EDGES, MOST_BANDS = 256, 1024
#: Edges (over all bins), places or cells that are broadcast.
BROADCAST_EDGES = 100_000
#: Cells along a side of a candidate bin, from round to round, and places per cell below which cells are not worth a round.
CELLS_OF_BIN, PLACES_PER_CELL = (2, 8, 32, 128), 8
#: Degrees by which an edge is taken to be thicker than it is, far beyond any rounding.
MARGIN = 1e-9


def _signed(x: Column) -> Column:
    """Longitude in [-180, 180]; both seam values are kept."""
    return (
        F.when(x < -180.0, F.pmod(x + 180.0, F.lit(360.0)) - 180.0)
        .when(x > 180.0, 180.0 - F.pmod(180.0 - x, F.lit(360.0)))
        .otherwise(x)
    )


def lon_bin(x: Column) -> Column:
    return F.least(F.floor((_signed(x) + 180.0) / 360.0 * LON_BINS), F.lit(LON_BINS - 1)).cast("int")


def lat_bin(y: Column) -> Column:
    inside = F.least(F.greatest(y, F.lit(-90.0)), F.lit(90.0))
    return F.least(F.floor((inside + 90.0) / 180.0 * LAT_BINS), F.lit(LAT_BINS - 1)).cast("int")


def _near(x: Column, anchor: Column) -> Column:
    """Longitude moved by whole turns to lie within half a turn of the anchor."""
    turns = (x - anchor) / 360.0
    # round half away from zero
    whole = F.signum(turns) * F.floor(F.abs(turns) + 0.5)
    return F.when(F.abs(x - anchor) <= 180.0, x).otherwise(x - 360.0 * whole)


def prepare_rings(rings: DataFrame) -> DataFrame:
    """Edges unwrapped around the first vertex, and bounding boxes.

    ``rings``: ring_id, polygon_id, points ARRAY<STRUCT<lon, lat>>.
    """
    pts = F.col("points")
    anchor = pts[0]["lon"]
    n = F.size(pts)
    edges = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            _near(pts[i]["lon"], anchor).alias("x1"), pts[i]["lat"].alias("y1"),
            _near(pts[F.when(i == 0, n - 1).otherwise(i - 1)]["lon"], anchor).alias("x0"),
            pts[F.when(i == 0, n - 1).otherwise(i - 1)]["lat"].alias("y0"),
        ),
    )
    lons, lats = F.transform(pts, lambda p: p["lon"]), F.transform(pts, lambda p: p["lat"])
    return rings.filter(n >= 3).select(
        "ring_id", "polygon_id", anchor.alias("anchor"), edges.alias("edges"),
        F.array_min(lons).alias("w"), F.array_max(lons).alias("e"), F.array_min(lats).alias("s"), F.array_max(lats).alias("n"),
    )


def _finite() -> Column:
    """Has the ring finite coordinates of a sensible size only?"""
    sound = lambda x: F.coalesce(F.abs(x) <= 1e6, F.lit(False))
    return F.forall("edges", lambda v: sound(v["x1"]) & sound(v["y1"]))


def ring_bins(prepared: DataFrame) -> DataFrame:
    """One row per ring and candidate bin it may cover.

    A ring at least half the globe wide is taken as crossing the seam and goes to all
    longitude bins of its latitudes; a box that wraps goes to both ends.
    """
    first, last = lon_bin(F.col("w")), lon_bin(F.col("e"))
    end = F.lit(LON_BINS - 1)
    lons = (
        F.when(F.col("e") - F.col("w") >= 180.0, F.sequence(F.lit(0), end))
        .when(first <= last, F.sequence(first, last))
        .otherwise(F.concat(F.sequence(first, end), F.sequence(F.lit(0), last)))
    )
    lats = F.sequence(lat_bin(F.col("s")), lat_bin(F.col("n")))
    return prepared.withColumn("bin_lat", F.explode(lats)).withColumn("bin_lon", F.explode(lons))


def edge_bins(prepared: DataFrame) -> DataFrame:
    """The edges of rings ``_ring`` in the candidate bins of the points they can count for.

    An edge counts for points at its latitudes and to the west of it; horizontal edges never do.
    """
    edges = prepared.select("*", F.explode("edges").alias("_edge")).select(*[c for c in prepared.columns if c != "edges"], "_edge.*")
    edges = edges.filter("y0 <> y1")
    lats = F.sequence(lat_bin(F.least("y0", "y1")), lat_bin(F.greatest("y0", "y1")))
    first, last, end = lon_bin(F.col("w")), lon_bin(F.col("e")), F.lit(LON_BINS - 1)
    plain = (F.col("w") >= -180.0) & (F.col("e") <= 180.0)
    lons = (
        F.when(F.col("e") - F.col("w") >= 180.0, F.sequence(F.lit(0), end))
        .when(plain, F.sequence(first, lon_bin(F.greatest("x0", "x1"))))
        .when(first <= last, F.sequence(first, last))
        .otherwise(F.concat(F.sequence(first, end), F.sequence(F.lit(0), last)))
    )
    return edges.withColumn("bin_lat", F.explode(lats)).withColumn("bin_lon", F.explode(lons))


def mark_bins(prepared: DataFrame) -> DataFrame:
    """The edges, horizontal ones too, in the candidate bins they touch; coordinates must be finite."""
    edges = prepared.select("*", F.explode("edges").alias("_edge")).select(*[c for c in prepared.columns if c != "edges"], "_edge.*")
    lats = F.sequence(lat_bin(F.least("y0", "y1") - MARGIN), lat_bin(F.greatest("y0", "y1") + MARGIN))

    def turn_bin(x: Column) -> Column:
        return F.floor((x + 180.0) / 360.0 * LON_BINS)

    west, east = turn_bin(F.least("x0", "x1") - MARGIN), turn_bin(F.greatest("x0", "x1") + MARGIN)
    lons = F.transform(F.sequence(west, F.least(east, west + LON_BINS - 1)), lambda i: F.pmod(i, F.lit(LON_BINS)).cast("int"))
    return edges.withColumn("bin_lat", F.explode(lats)).withColumn("bin_lon", F.explode(lons))


def _band(lat: Column) -> Column:
    """Band of a latitude inside its bin, which has ``bands`` of them."""
    south = F.col("bin_lat") * (180.0 / LAT_BINS) - 90.0
    at = F.floor((lat - south) / (180.0 / LAT_BINS) * F.col("bands")).cast("int")
    return F.greatest(F.least(at, F.col("bands") - 1), F.lit(0))


def _band_counts(binned: DataFrame) -> DataFrame:
    """Bands of every bin: so many that a band holds few edges, but not more than the edges are short for.

    Edges as tall as their bin lie in all of its bands, which only copies them.  At most LAT_BINS * LON_BINS rows.
    """
    high = 180.0 / LAT_BINS
    south = F.col("bin_lat") * high - 90.0
    tall = F.greatest(F.least(F.greatest("y0", "y1"), south + high) - F.greatest(F.least("y0", "y1"), south), F.lit(0.0))
    useful = F.ceil(F.least(F.try_divide(F.lit(high), F.avg(tall)), F.lit(float(MOST_BANDS))))
    wanted = F.ceil(F.count(F.lit(1)) / BAND_EDGES)
    return binned.groupBy("bin_lat", "bin_lon").agg(F.least(wanted, useful, F.lit(MOST_BANDS)).cast("int").alias("bands"))


def _banded(binned: DataFrame, sizes: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows in every band of their bin from one latitude to another."""
    placed = binned.join(F.broadcast(sizes), ["bin_lat", "bin_lon"])
    return placed.withColumn("band", F.explode(F.sequence(_band(low), _band(high)))).drop("bands")


def _crosses(lat: Column, lon: Column) -> Column:
    """Does the edge cross the ray from a point of the ring's bounding box to the east?"""
    boxed = (lat >= F.col("s")) & (lat <= F.col("n")) & (
        (F.col("e") - F.col("w") >= 180.0) | ((lon >= F.col("w")) & (lon <= F.col("e")))
    )
    spans = (F.col("y1") > lat) != (F.col("y0") > lat)
    at = F.try_divide((F.col("x0") - F.col("x1")) * (lat - F.col("y1")), F.col("y0") - F.col("y1")) + F.col("x1")
    return boxed & spans & (_near(lon, F.col("anchor")) < at)


def _touches(lat: Column, lon: Column, half: float) -> Column:
    """May the edge meet the square cell around a point?  It surely does not where this is false."""
    dx, dy, reach = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), half + MARGIN
    mid_x, mid_y = F.col("x0") + dx / 2, F.col("y0") + dy / 2
    across = _near(lon, F.col("anchor")) - mid_x
    across, up = across - 360.0 * F.floor(across / 360.0 + 0.5), lat - mid_y
    # the nearest turn of the edge; an edge of almost half the globe may meet the cell in another one, too
    apart = F.abs(dx * up - dy * across) > reach * (F.abs(dx) + F.abs(dy))
    boxed = (F.abs(across) <= F.abs(dx) / 2 + reach) & (F.abs(up) <= F.abs(dy) / 2 + reach)
    return boxed & (~apart | (F.abs(dx) / 2 + reach >= 90.0))


def _meet(few: DataFrame, edges: DataFrame) -> DataFrame:
    """Places or cells with the edges of their bin and band; the smaller side is broadcast if it is small."""
    keys = ["bin_lat", "bin_lon", "band"]
    if at_most(few, BROADCAST_EDGES):
        return edges.join(F.broadcast(few), keys)
    return few.join(sized_broadcast(edges, BROADCAST_EDGES), keys)


def _settled_cells(cells: DataFrame, prepared: DataFrame, sizes: DataFrame, unit: str, side: float) -> DataFrame:
    """Cells (``_r``, ``_c``) with ``inside``: are all of their points inside, or none (else NULL)?

    Where no edge of a polygon meets a cell, its points agree with the centre of the cell.
    """
    half, lat, lon = side / 2, F.col("lat"), F.col("lon")
    centres = cells.withColumn("lat", (F.col("_r") + 0.5) * side).withColumn("lon", (F.col("_c") + 0.5) * side)
    placed = centres.withColumn("bin_lat", lat_bin(lat)).withColumn("bin_lon", lon_bin(lon)).join(F.broadcast(sizes), ["bin_lat", "bin_lon"])
    placed = placed.withColumn("_own", _band(lat)).withColumn("band", F.explode(F.sequence(_band(lat - half), _band(lat + half))))
    placed = placed.withColumn("_own", F.col("_own") == F.col("band")).drop("bands")
    low, high = F.least("y0", "y1") - MARGIN, F.greatest("y0", "y1") + MARGIN
    both = edge_bins(prepared).withColumn("_ray", F.lit(True)).unionByName(mark_bins(prepared).withColumn("_ray", F.lit(False)))
    met = _meet(placed, _banded(both, sizes, low, high))
    hits = met.filter(F.when(F.col("_ray"), F.col("_own") & _crosses(lat, lon)).otherwise(_touches(lat, lon, half)))
    odd = F.count(F.when(F.col("_ray"), 1)) % 2 == 1
    found = hits.groupBy("_r", "_c", unit).agg(odd.alias("_odd"), F.bool_or(~F.col("_ray")).alias("_met"))
    told = found.groupBy("_r", "_c").agg(F.bool_or(F.col("_odd") & ~F.col("_met")).alias("_in"), F.bool_or("_met").alias("_open"))
    state = F.when(F.col("_in"), True).when(F.col("_open"), None).otherwise(False)
    return cells.join(told, ["_r", "_c"], "left").select("_r", "_c", state.alias("inside"))


def in_polygons(points: DataFrame, rings: DataFrame, key: list[str], holes: bool = False) -> DataFrame:
    """Add ``inside`` to points (``lat``, ``lon``): does any ring contain the point?

    Cells of shrinking size settle most places at once: those that lie whole in a polygon, and those that
    nothing covers.  Only the places of cells that stay open meet single edges: those of their five-degree
    bin and, where a bin holds many short edges, of their band of latitude.  Crossings are counted by
    partial aggregation, so ``key`` may repeat or be NULL.  With ``holes`` the rings of one polygon cancel
    out pairwise; without, every ring counts alone.  Rings with a vertex that is not finite leave all
    places to single edges.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = prepare_rings(rings).drop("ring_id").repartition(parts).withColumn("_ring", F.monotonically_increasing_id())
    prepared = cut_lineage(numbered)
    # crossings of a polygon are odd if those of an odd number of its rings are
    unit = "polygon_id" if holes else "_ring"
    sizes = cut_lineage(_band_counts(edge_bins(prepared).unionByName(mark_bins(prepared.filter(_finite())))))
    lat, lon = F.col("lat"), F.col("lon")
    rest = cut_lineage(points.select("lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL").distinct())
    found = []
    if prepared.filter(~_finite()).isEmpty():
        for cells_of_bin in CELLS_OF_BIN:
            side = 180.0 / LAT_BINS / cells_of_bin
            common = (F.abs(lat) <= 90.0) & (F.abs(lon) <= 1e6)
            at = rest.withColumn("_r", F.when(common, F.floor(lat / side))).withColumn("_c", F.when(common, F.floor(lon / side)))
            cells = cut_lineage(at.filter("_r IS NOT NULL").select("_r", "_c").distinct())
            n_cells = cells.count()
            if n_cells == 0 or n_cells * PLACES_PER_CELL > rest.count():
                break
            settled = cut_lineage(_settled_cells(cells, prepared, sizes, unit, side))
            told = cut_lineage(at.join(sized_broadcast(settled), ["_r", "_c"], "left"))
            found.append(told.filter("inside").select("lat", "lon"))
            rest = told.filter("inside IS NULL").select("lat", "lon")
    edges = _banded(edge_bins(prepared), sizes, F.least("y0", "y1"), F.greatest("y0", "y1"))
    placed = rest.withColumn("bin_lat", lat_bin(lat)).withColumn("bin_lon", lon_bin(lon))
    met = _meet(_banded(placed, sizes, lat, lat), edges)
    odd = met.filter(_crosses(lat, lon)).groupBy("lat", "lon", unit).agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1")
    inside = reduce(DataFrame.unionByName, found, odd.select("lat", "lon").distinct()).withColumn("inside", F.lit(True))
    return points.join(inside, ["lat", "lon"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def border_cells(mask: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sea cells with a land cell among their eight neighbours; no wrap at the edges.

    ``mask``: r, c, land and the columns ``by``.
    """
    by = by or []
    around = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]
    offsets = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in around])
    near_land = mask.filter("land").select(*by, "r", "c", F.explode(offsets).alias("_o")).select(
        *by, (F.col("r") + F.col("_o.dr")).alias("r"), (F.col("c") + F.col("_o.dc")).alias("c")
    )
    return mask.filter(~F.col("land")).join(near_land, [*by, "r", "c"], "left_semi")


_TOPOLOGY = (
    "STRUCT<transform: STRUCT<scale: ARRAY<DOUBLE>, translate: ARRAY<DOUBLE>>, "
    "arcs: ARRAY<ARRAY<ARRAY<BIGINT>>>, "
    "objects: MAP<STRING, STRUCT<geometries: ARRAY<STRUCT<type: STRING, arcs: STRING>>>>>"
)


def read_topology(spark: SparkSession, path: str, layer: str = "land", packed: bool = False) -> DataFrame:
    """Rings of the topology files matching ``path``, or of the documents packed there by ``write_documents``."""
    if packed:
        return decode_topology(read_documents(spark, path).withColumnRenamed("name", "doc"), layer)
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))
    return decode_topology(docs, layer)


def decode_topology(docs: DataFrame, layer: str = "land") -> DataFrame:
    """Closed rings of topology documents (``doc``, ``text``).

    Arcs are delta-coded integers (scaled and shifted), a negative reference runs an arc
    backwards, and the first vertex of each further arc of a ring repeats its
    predecessor.  Result: doc, polygon_id, ring_id, points.
    """
    parsed = docs.select("doc", F.from_json("text", _TOPOLOGY).alias("t"))
    vertices = parsed.select(
        "doc", F.col("t.transform.scale").alias("s"), F.col("t.transform.translate").alias("o"),
        F.posexplode("t.arcs").alias("arc", "_pts"),
    ).select("doc", "s", "o", "arc", F.posexplode("_pts").alias("i", "_d"))
    # an arc is one array of a document, so its vertices fit one task
    along = Window.partitionBy("doc", "arc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = vertices.select(
        "doc", "arc", "i", F.count(F.lit(1)).over(Window.partitionBy("doc", "arc")).alias("_len"),
        (F.sum(F.col("_d")[0]).over(along) * F.col("s")[0] + F.col("o")[0]).alias("lon"),
        (F.sum(F.col("_d")[1]).over(along) * F.col("s")[1] + F.col("o")[1]).alias("lat"),
    )
    geometry = parsed.select("doc", F.posexplode(F.col("t.objects")[layer]["geometries"]).alias("g", "_g"))
    text = F.col("_g.arcs")
    # Polygon: rings of references; MultiPolygon: polygons of rings
    nested = F.when(F.ltrim(text).rlike(r"^\[\s*\[\s*\["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    refs = (
        geometry.select("doc", "g", F.posexplode(F.from_json(nested, "ARRAY<ARRAY<ARRAY<BIGINT>>>")).alias("p", "_rings"))
        .select("doc", "g", "p", F.posexplode("_rings").alias("ring", "_refs"))
        .select("doc", "g", "p", "ring", F.posexplode("_refs").alias("part", "ref"))
        .withColumn("arc", F.when(F.col("ref") < 0, -F.col("ref") - 1).otherwise(F.col("ref")).cast("int"))
    )
    order = F.when(F.col("ref") < 0, F.col("_len") - 1 - F.col("i")).otherwise(F.col("i"))
    walked = refs.join(placed, ["doc", "arc"]).withColumn("step", order).filter((F.col("part") == 0) | (F.col("step") > 0))
    rings = walked.groupBy("doc", "g", "p", "ring").agg(
        F.sort_array(F.collect_list(F.struct("part", "step", "lon", "lat"))).alias("_w")
    )
    pts = F.transform("_w", lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat")))
    closed = rings.withColumn("points", pts).filter(F.size("points") >= 3).withColumn(
        "points",
        F.when(F.col("points")[0] == F.element_at("points", -1), F.col("points")).otherwise(
            F.concat("points", F.slice("points", 1, 1))
        ),
    )
    polygon = F.concat_ws("/", F.col("g").cast("string"), F.col("p").cast("string"))
    return closed.select(
        "doc", polygon.alias("polygon_id"), F.concat_ws("/", polygon, F.col("ring").cast("string")).alias("ring_id"), "points"
    )


