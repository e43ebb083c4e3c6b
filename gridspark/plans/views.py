"""Gridded data made of the driver's tables: DataFrames and the same views as SQL.

The grid has 10 rows, 7 levels, 7 years and one column per hundred parts, so the
number of cells grows with the tables.  Absent cells are missing data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GridSet
from ..operators.decode import decode


_TABLES: dict[tuple[str, str, str], DataFrame] = {}
_GRIDS: dict[tuple[str, str], GridSet] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; its schema is looked up once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        # labels are UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _TABLES[key]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed cells of ``price`` and ``qty`` in datasets 1 (A), 2 (N) and 3 (R)."""
    line = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    wide = line.groupBy(
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).cast("int").alias("dataset_id"),
        (F.year("l_shipdate") - 1995).cast("int").alias("t"),
        (F.col("l_linenumber") - 1).cast("int").alias("z"),
        (F.col("l_suppkey") % 10).cast("int").alias("r"),
        F.floor(F.col("l_partkey") / 100).cast("int").alias("c"),
    ).agg(F.floor(F.max("l_extendedprice")).cast("double").alias("price"), F.max("l_quantity").alias("qty"))
    return wide.unpivot(["dataset_id", "t", "z", "r", "c"], ["price", "qty"], "variable", "raw").select(
        "dataset_id", "variable", "t", "z", "r", "c", "raw"
    )


def attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing: ``qty`` exercises fill, missing, range, scale and offset."""
    rows = [
        (d, v, *p)
        for d in (1, 2, 3)
        for v, p in (
            ("price", (None,) * 6),
            ("qty", (50.0, 1.0, 3.0, 48.0, 0.5, 10.0)),
        )
    ]
    return spark.createDataFrame(
        rows,
        "dataset_id INT, variable STRING, fill DOUBLE, missing DOUBLE, valid_min DOUBLE, "
        "valid_max DOUBLE, scale_factor DOUBLE, add_offset DOUBLE",
    )


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(cells(spark, sf_dir), attrs(spark, sf_dir))


def n_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: number of grid columns."""
    return table(spark, sf_dir, "part").agg(
        (F.floor(F.max("p_partkey") / 100) + 1).cast("int").alias("n_cols")
    )


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-D coordinates; longitudes follow the 0..360 convention."""
    n = n_cols(spark, sf_dir)
    lon = (
        table(spark, sf_dir, "part")
        .select(F.floor(F.col("p_partkey") / 100).cast("int").alias("idx")).distinct()
        .withColumn("dim", F.lit("lon"))
        .withColumn("coord", 360.0 * F.col("idx") / n.scalar())
    )
    line = table(spark, sf_dir, "lineitem")
    lat = line.select((F.col("l_suppkey") % 10).cast("int").alias("idx")).distinct()
    lat = lat.withColumn("dim", F.lit("lat")).withColumn("coord", F.col("idx") * 18.0 - 81.0)
    lev = line.select((F.col("l_linenumber") - 1).cast("int").alias("idx")).distinct()
    lev = lev.withColumn("dim", F.lit("lev")).withColumn("coord", 1000.0 - 100.0 * F.col("idx"))
    year = line.select((F.year("l_shipdate") - 1995).cast("int").alias("idx")).distinct()
    year = year.withColumn("dim", F.lit("time")).withColumn("coord", F.col("idx") * 365.0)
    out = lon.unionByName(lat).unionByName(lev).unionByName(year)
    return out.select(F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("dataset_id"), "dim", "idx", "coord")


def coord2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curvilinear coordinates, one row per (r, c) of the grid."""
    n = n_cols(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    rc = part.select(
        (F.col("p_partkey") % 10).cast("int").alias("r"), F.floor(F.col("p_partkey") / 100).cast("int").alias("c")
    ).distinct()
    turn = 360.0 * F.col("c") / n.scalar()
    return rc.select(
        F.lit(1).alias("dataset_id"), "r", "c",
        (F.col("r") * 18.0 - 81.0 + turn / 64.0).alias("lat"),
        (turn - 180.0 + 0.25 * F.col("r")).alias("lon"),
    )


def area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static field without time and level."""
    return table(spark, sf_dir, "part").groupBy(
        (F.col("p_partkey") % 10).cast("int").alias("r"),
        F.floor(F.col("p_partkey") / 100).cast("int").alias("c"),
    ).agg(F.floor(F.max("p_retailprice")).cast("double").alias("raw"))


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis lengths, measured from the coordinates."""
    role = (
        F.when(F.col("dim") == "lon", "longitude").when(F.col("dim") == "lat", "latitude")
        .when(F.col("dim") == "lev", "depth").otherwise("time")
    )
    return (
        axes(spark, sf_dir).groupBy("dataset_id", "dim")
        .agg((F.max("idx") + 1).cast("int").alias("length")).withColumn("role", role)
    )


def vars_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of the three datasets; dataset 3 has ``qty`` in another unit."""
    flag = F.col("l_returnflag")
    files = table(spark, sf_dir, "lineitem").select(
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).cast("int").alias("dataset_id")
    ).distinct()
    names = files.select("dataset_id", F.explode(F.array(F.lit("price"), F.lit("qty"))).alias("variable"))
    unit = (
        F.when(F.col("variable") == "price", "USD")
        .when(F.col("dataset_id") == 3, "dozen").otherwise("1")
    )
    return names.select(
        "dataset_id",
        F.when(F.col("variable") == "price", 0).otherwise(1).cast("int").alias("pos"),
        "variable",
        F.array(F.lit("time"), F.lit("lev"), F.lit("lat"), F.lit("lon")).alias("dims"),
        F.lit(True).alias("numeric"),
        unit.alias("units"),
        F.initcap("variable").alias("long_name"),
        F.lit(None).cast("string").alias("standard_name"),
    )


def gridset(spark: SparkSession, sf_dir: str) -> GridSet:
    """Cells plus catalogue; the catalogue tables are read many times, so they are kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRIDS:
        _GRIDS[key] = GridSet(
            cells=decoded(spark, sf_dir), vars=vars_(spark, sf_dir).persist(), dims=dims(spark, sf_dir).persist(),
            attrs=attrs(spark, sf_dir), axes=axes(spark, sf_dir).persist(), coord2d=coord2d(spark, sf_dir),
        )
    return _GRIDS[key]


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scattered points, one per user."""
    ev = table(spark, sf_dir, "events")
    n = ev.agg((F.max("user_id") + 1).alias("n"))
    u = F.col("user_id")
    rows = ev.select("user_id").distinct().withColumn("_n", n.scalar())
    return rows.select(
        F.lit(1).alias("dataset_id"), u.cast("int").alias("m"),
        (-90.0 + 180.0 * ((u * 37) % F.col("_n") + 0.5) / F.col("_n")).alias("lat"),
        (-180.0 + 360.0 * ((u * u * 7 + u * 61) % 3571 + 0.5) / 3571.0).alias("lon"),
    )


def mesh_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(
        F.lit(1).alias("dataset_id"), F.lit("value").alias("variable"),
        (F.dayofmonth("ts") - 1).cast("int").alias("t"), F.lit(0).alias("z"),
        F.col("user_id").cast("int").alias("m"),
    ).agg(F.max("value").alias("raw"))


def idx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index text: one object per 750 orders, one line per order."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.floor(F.col("o_orderkey") / 750).cast("int").alias("obj"),
        (F.col("o_orderkey") % 750 + 1).cast("int").alias("ord"),
        (F.col("o_orderkey") % 37 + 100).cast("long").alias("len"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("day"),
        F.col("o_orderpriority").alias("prio"),
    )
    # at most 750 rows per object
    w = Window.partitionBy("obj").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("obj")
    rows = rows.withColumn("off", F.coalesce(F.sum("len").over(w), F.lit(0))).withColumn(
        "total", F.sum("len").over(whole)
    )
    line = F.concat_ws(
        ":", F.col("ord").cast("string"), F.col("off").cast("string"),
        F.concat(F.lit("d="), F.col("day"), F.lit("00")), F.col("prio"), F.lit("surface"),
    )
    return rows.select("obj", "ord", line.alias("line"), "off", "total")


SQL: dict[str, str] = {
    "cells": """
        SELECT dataset_id, variable, t, z, r, c, raw FROM (
          SELECT CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS INT) dataset_id,
                 'price' variable, CAST(year(l_shipdate)-1995 AS INT) t, CAST(l_linenumber-1 AS INT) z,
                 CAST(l_suppkey % 10 AS INT) r, CAST(l_partkey // 100 AS INT) c,
                 CAST(floor(max(l_extendedprice)) AS DOUBLE) raw
          FROM lineitem GROUP BY 1,2,3,4,5,6
          UNION ALL
          SELECT CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS INT), 'qty',
                 CAST(year(l_shipdate)-1995 AS INT), CAST(l_linenumber-1 AS INT),
                 CAST(l_suppkey % 10 AS INT), CAST(l_partkey // 100 AS INT), max(l_quantity)
          FROM lineitem GROUP BY 1,2,3,4,5,6) u""",
    "decoded": """
        SELECT *, CASE WHEN variable = 'qty' THEN raw*0.5e0 + 10e0 ELSE raw END AS value,
               CASE WHEN variable = 'price' THEN 'Finite' WHEN raw = 50 THEN 'Fill' WHEN raw = 1 THEN 'Missing'
                    WHEN raw < 3 OR raw > 48 THEN 'InvalidRange' ELSE 'Finite' END AS validity
        FROM cells""",
    # finite cells only, v = visible value
    "fin": "SELECT dataset_id, variable, t, z, r, c, value AS v FROM decoded WHERE validity = 'Finite'",
    "ncols": "SELECT CAST(max(p_partkey) // 100 + 1 AS INT) AS n FROM part",
    "axes": """
        SELECT d.dataset_id, a.dim, a.idx, a.coord FROM (
          SELECT DISTINCT 'lon' dim, CAST(p_partkey // 100 AS INT) idx,
                 360e0 * CAST(p_partkey // 100 AS INT) / (SELECT n FROM ncols) coord FROM part
          UNION ALL SELECT DISTINCT 'lat', CAST(l_suppkey % 10 AS INT), CAST(l_suppkey % 10 AS INT)*18e0-81e0 FROM lineitem
          UNION ALL SELECT DISTINCT 'lev', CAST(l_linenumber-1 AS INT), 1000e0-100e0*(l_linenumber-1) FROM lineitem
          UNION ALL SELECT DISTINCT 'time', CAST(year(l_shipdate)-1995 AS INT), (year(l_shipdate)-1995)*365e0 FROM lineitem) a
        CROSS JOIN (SELECT unnest([1,2,3]) dataset_id) d""",
    "coord2d": """
        SELECT 1 AS dataset_id, r, c, r*18e0-81e0 + 360e0*c/n/64e0 AS lat, 360e0*c/n - 180e0 + 0.25e0*r AS lon
        FROM (SELECT DISTINCT CAST(p_partkey % 10 AS INT) r, CAST(p_partkey // 100 AS INT) c FROM part) p, ncols""",
    "area": """
        SELECT CAST(p_partkey % 10 AS INT) r, CAST(p_partkey // 100 AS INT) c,
               CAST(floor(max(p_retailprice)) AS DOUBLE) raw FROM part GROUP BY 1,2""",
    "dims": """
        SELECT dataset_id, dim, CAST(max(idx)+1 AS INT) AS length,
               CASE dim WHEN 'lon' THEN 'longitude' WHEN 'lat' THEN 'latitude' WHEN 'lev' THEN 'depth' ELSE 'time' END AS role
        FROM axes GROUP BY dataset_id, dim""",
    "vars": """
        SELECT DISTINCT dataset_id, CAST(CASE variable WHEN 'price' THEN 0 ELSE 1 END AS INT) pos, variable,
               ['time','lev','lat','lon'] dims, true AS "numeric",
               CASE WHEN variable='price' THEN 'USD' WHEN dataset_id=3 THEN 'dozen' ELSE '1' END units,
               CASE variable WHEN 'price' THEN 'Price' ELSE 'Qty' END long_name, CAST(NULL AS VARCHAR) standard_name
        FROM cells""",
    "mesh": """
        SELECT DISTINCT 1 AS dataset_id, CAST(user_id AS INT) m,
               -90e0 + 180e0*((user_id*37) % n + 0.5e0)/n AS lat,
               -180e0 + 360e0*((user_id*user_id*7 + user_id*61) % 3571 + 0.5e0)/3571e0 AS lon
        FROM events, (SELECT max(user_id)+1 AS n FROM events) x""",
    "mesh_values": """
        SELECT 1 AS dataset_id, 'value' AS variable, CAST(day(ts)-1 AS INT) t, 0 AS z, CAST(user_id AS INT) m, max(value) raw
        FROM events GROUP BY ALL""",
    "idx_lines": """
        SELECT obj, ord, concat_ws(':', CAST(ord AS VARCHAR), CAST(off AS VARCHAR), concat('d=', day0, '00'), prio, 'surface') line,
               off, total FROM (
          SELECT obj, ord, CAST(coalesce(sum(len) OVER (PARTITION BY obj ORDER BY ord
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) off,
                 CAST(sum(len) OVER (PARTITION BY obj) AS BIGINT) total, day0, prio, len FROM (
            SELECT CAST(o_orderkey // 750 AS INT) obj, CAST(o_orderkey % 750 + 1 AS INT) ord,
                   o_orderkey % 37 + 100 len, strftime(o_orderdate, '%Y%m%d') day0, o_orderpriority prio FROM orders) a) b""",
}

_DEPENDS = {
    "decoded": ("cells",), "fin": ("cells", "decoded"), "axes": ("ncols",), "coord2d": ("ncols",),
    "dims": ("ncols", "axes"), "vars": ("cells",),
}


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """Put the named views, and those they need, in front of a DuckDB statement."""
    wanted: list[str] = []
    for name in names:
        for dep in (*_DEPENDS.get(name, ()), name):
            if dep not in wanted:
                wanted.append(dep)
    if not wanted:
        return sql.strip()
    head = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in wanted)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    glue = ",\n" + body[5:] if body.startswith("WITH ") else "\n" + body
    return f"WITH {head}{glue}"
