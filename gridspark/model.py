"""Data model: the tables a gridded collection is made of.

``cells`` is the fact table: one row per grid cell, with the packed value in
``raw``.  Decoding adds ``value`` and ``validity``; a cell that is not there is
missing.  The other tables are the catalogue.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

CELL_KEY = ["t", "z", "r", "c"]
PLANE_KEY = ["dataset_id", "variable", "t", "z"]
FULL_KEY = ["dataset_id", "variable", *CELL_KEY]

# The validity classes of a cell.
FINITE, FILL, MISSING, INVALID_RANGE = "Finite", "Fill", "Missing", "InvalidRange"
NAN, POS_INF, NEG_INF = "NaN", "PosInf", "NegInf"
# The roles of an axis.
ROLES = ("time", "depth", "latitude", "longitude", "other")

CELLS = "dataset_id INT, variable STRING, t INT, z INT, r INT, c INT, raw DOUBLE"
DECODED = CELLS + ", value DOUBLE, validity STRING"
DATASETS = "dataset_id INT, path STRING, format STRING, identity STRING"
DIMS = "dataset_id INT, dim STRING, length INT, role STRING"
VARS = (
    "dataset_id INT, pos INT, variable STRING, dims ARRAY<STRING>, numeric BOOLEAN, "
    "units STRING, long_name STRING, standard_name STRING"
)
ATTRS = (
    "dataset_id INT, variable STRING, fill DOUBLE, missing DOUBLE, valid_min DOUBLE, "
    "valid_max DOUBLE, valid_range ARRAY<DOUBLE>, scale_factor DOUBLE, add_offset DOUBLE"
)
AXES = "dataset_id INT, dim STRING, idx INT, coord DOUBLE"
COORD2D = "dataset_id INT, r INT, c INT, lat DOUBLE, lon DOUBLE"
FRAMES = "variable STRING, dataset_id INT, t INT, label STRING"


class GridError(ValueError):
    """A request that does not fit the catalogue."""


@dataclass(frozen=True)
class GridSet:
    """One or more datasets: the decoded cells and their catalogue tables.

    ``dims`` and ``vars`` are required by the operators that validate against the
    catalogue; every other table is optional.
    """

    cells: DataFrame
    vars: DataFrame | None = None
    dims: DataFrame | None = None
    attrs: DataFrame | None = None
    axes: DataFrame | None = None
    coord2d: DataFrame | None = None
    datasets: DataFrame | None = None

    def with_cells(self, cells: DataFrame) -> "GridSet":
        return replace(self, cells=cells)

    def variable(self, name: str, dataset_id: int | None = None) -> DataFrame:
        rows = self.cells.filter(self.cells.variable == name)
        return rows if dataset_id is None else rows.filter(rows.dataset_id == dataset_id)
