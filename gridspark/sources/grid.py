"""Grid datasets as folders of Parquet tables: reading, globbing and writing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.scalars import plane_name
from ..model import CELL_KEY, GridError, GridSet
from ..operators.binning import limits
from ..operators.joins import lookup_join

_TABLES = ("vars", "dims", "attrs", "axes", "coord2d", "datasets")


def read_grid(spark: SparkSession, path: str) -> GridSet:
    """One collection: ``<path>/cells`` partitioned by dataset and variable, plus its catalogue.

    Filters on dataset and variable prune partitions; filters on t, z, r and c reach the
    Parquet scan.
    """
    tables = {}
    for name in _TABLES:
        try:
            tables[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            tables[name] = None
    return GridSet(cells=spark.read.parquet(f"{path}/cells"), **tables)


def write_grid(gs: GridSet, path: str) -> None:
    """Write a collection so that :func:`read_grid` can prune and push down.

    Rows of a partition are sorted by (t, z, r, c), so row groups carry tight ranges.
    The rebalance hint splits a variable that holds most of the cells.
    """
    cells = gs.cells.hint("rebalance", "dataset_id", "variable", "t", "z")
    cells.sortWithinPartitions("dataset_id", "variable", *CELL_KEY).write.mode("overwrite").partitionBy(
        "dataset_id", "variable"
    ).parquet(f"{path}/cells")
    for name in _TABLES:
        rows = getattr(gs, name)
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")


def matched_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a ``*`` / ``?`` pattern matches, sorted; a listing by the file system, no data is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(status.getPath().toString() for status in system.globStatus(path) or [])


def _plain(path: Column) -> Column:
    """A path without the scheme of local files, of which several spellings exist."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_grids(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells of many files or folders given by paths or ``*`` / ``?`` patterns.

    Every matched path is one dataset, however many files it has, also if it holds no rows.  Datasets are
    numbered by pattern, then by sorted path; a path matched twice counts once.  Returns
    the cells with ``dataset_id`` and the table ``datasets``.  A pattern that matches nothing
    is read as a plain path, so a wrong name is reported.
    """
    if not paths:
        raise GridError("no dataset given")
    parts, found = [], {}
    for i, pattern in enumerate(paths):
        rows = spark.read.parquet(pattern).select("*", _plain(F.col("_metadata.file_path")).alias("_path"), F.lit(i).alias("_pattern"))
        parts.append(rows.drop("dataset_id") if "dataset_id" in rows.columns else rows)
        for path in matched_paths(spark, pattern):
            found.setdefault(re.sub("^file:/+", "/", path), (i, path))
    names = [(n, root, path, i) for n, (root, (i, path)) in enumerate(found.items(), 1)]
    table = spark.createDataFrame(names, "dataset_id INT, _root STRING, path STRING, _pattern INT")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # a file lies at or below its dataset's path; patterns match at one depth each
    depths = sorted({root.count("/") + 1 for root in found})
    roots = F.array(*[F.substring_index("_path", "/", d) for d in depths])
    rows = rows.withColumn("_root", F.explode(F.array_distinct(roots)))
    cells = lookup_join(rows, table.drop("path"), ["_root", "_pattern"], "inner").drop("_root", "_pattern", "_path")
    datasets = table.select("dataset_id", "path", F.lit("parquet").alias("format"), F.col("path").alias("identity"))
    return cells, datasets


def with_plane_name(df: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Add ``plane_name`` from the file stem of the dataset (or its number)."""
    stem = F.concat(F.lit("dataset_"), F.col("dataset_id").cast("string"))
    rows = df
    if datasets is not None:
        name = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
        rows = lookup_join(rows, datasets.select("dataset_id", name.alias("_stem")), ["dataset_id"])
        stem = F.coalesce("_stem", stem)
    return rows.withColumn("plane_name", plane_name(stem, F.col("variable"), F.col("t"), F.col("z"))).drop("_stem")


def write_planes(df: DataFrame, path: str) -> None:
    """Write derived planes, one folder per dataset, variable, time and level.

    The rebalance hint gathers small planes and splits huge ones.
    """
    df.hint("rebalance", "dataset_id", "variable", "t", "z").write.mode("overwrite").partitionBy(
        "dataset_id", "variable", "t", "z"
    ).parquet(path)


def plane_metadata(
    df: DataFrame, vars_: DataFrame, labels: DataFrame | None = None, scale: str = "linear"
) -> DataFrame:
    """One row per plane: variable, units, names, time, depth index, scale and limits.

    ``labels``: dataset_id, t, label.  Planes without a usable value have NULL limits.
    """
    by = ["dataset_id", "variable", "t", "z"]
    facts = limits(df, by, scale)
    about = vars_.select("dataset_id", "variable", "units", "long_name", "standard_name")
    rows = lookup_join(facts, about, ["dataset_id", "variable"])
    if labels is not None:
        rows = lookup_join(rows, labels.select("dataset_id", "t", "label"), ["dataset_id", "t"])
    else:
        rows = rows.withColumn("label", F.lit(None).cast("string"))
    return rows.select(
        "dataset_id", "variable", "t", "units", "long_name", "standard_name", F.col("label").alias("time"),
        F.col("z").alias("depth_index"), F.lit(scale).alias("scale"),
        F.when(F.col("lo").isNotNull(), F.array("lo", "hi")).alias("limits"),
    )


def write_metadata(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


