"""Chunk references as a data source: ``spark.read.format("gridchunks")``.

The index of an array's chunks is a folder of Parquet files that Spark writes, one row per chunk with
the header of its array and the ranges of cells that it covers.  Planning reads the footers of that
folder only: a partition is a run of row groups, and filters on the array and on t, z, r
and c drop the row groups whose ranges they miss.  A task reads its rows, drops the chunks that
the filters miss, and decodes the others in the order of their objects; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .manifest import _chunk_cells, _placed, _reader

FORMAT = "gridchunks"
AXES = ("t", "z", "r", "c")
SCHEMA = "manifest STRING, variable STRING, t INT, z INT, r INT, c INT, rest ARRAY<INT>, dims ARRAY<STRING>, raw DOUBLE"
#: Rows of the index that a task decodes and a row group of the index holds.
TASK_CHUNKS = 2_000
_BATCH_CELLS = 200_000


def write_chunk_index(chunks: DataFrame, arrays: DataFrame, path: str) -> None:
    """Write the chunks of :func:`.manifest.chunk_index` for :func:`read_chunks`.

    Rows are sorted by array and cells, so that row groups cover tight ranges.
    """
    head = arrays.select("manifest", "variable", "shape", F.col("chunks").alias("size"), "dtype", "fill", "dims")
    rows = lookup_join(chunks, head, ["manifest", "variable"], "inner")
    rank = F.size("shape")
    # the last two axes are r and c, the first is t, the second z
    axis = {"t": (rank >= 3, F.lit(0)), "z": (rank >= 4, F.lit(1)), "r": (rank >= 2, rank - 2), "c": (rank >= 1, rank - 1)}

    def first(a: str) -> Column:
        has, i = axis[a]
        return F.when(has, F.get("idx", i) * F.get("size", i)).otherwise(0).cast("int")

    def last(a: str) -> Column:
        has, i = axis[a]
        return F.when(has, F.least((F.get("idx", i) + 1) * F.get("size", i), F.get("shape", i)) - 1).otherwise(0).cast("int")

    ranges = {f"{a}_first": first(a) for a in AXES} | {f"{a}_last": last(a) for a in AXES}
    order = ["variable", "t_first", "z_first", "r_first", "c_first", "manifest"]
    rows.withColumns(ranges).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option(
        "parquet.block.row.count.limit", TASK_CHUNKS
    ).parquet(path)


def read_chunks(spark: SparkSession, path: str, base: str | None = None, fill_missing: bool = False) -> DataFrame:
    """Cells of the indexed chunks, as :func:`.manifest.decode_chunks` gives them.

    The index and the objects must be readable through Arrow's file systems on every executor.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)
    reader = spark.read.format(FORMAT).option("path", path).option("fillMissing", str(fill_missing).lower())
    cells = (reader.option("base", base) if base else reader).load()
    extra = F.when(F.col("rest").isNotNull(), F.map_from_arrays(F.slice("dims", F.lit(3), F.size("rest")), F.col("rest")))
    return cells.select("manifest", "variable", *AXES, extra.alias("extra"), "raw")


class ChunkSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(dict(self.options))


class Piece(D.InputPartition):
    """Row groups of one index file."""

    def __init__(self, file: str, groups: list[int]):
        self.file, self.groups = file, groups


class ChunkReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}
        self.equal: dict[str, set[str]] = {}

    # -- planning, in the driver ---------------------------------------------------------

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Note what the filters tell about chunks.  Spark applies them again to the cells, which a chunk may overhang."""
        for f in filters:
            name = getattr(f, "attribute", (None,))[0]
            value = getattr(f, "value", None)
            if name in AXES and isinstance(f, D.In):
                self._bound(name, min(f.value), max(f.value))
            elif name in AXES and isinstance(value, int):
                if isinstance(f, (D.EqualTo, D.EqualNullSafe)):
                    self._bound(name, value, value)
                elif isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual)):
                    self._bound(name, value + isinstance(f, D.GreaterThan), None)
                elif isinstance(f, (D.LessThan, D.LessThanOrEqual)):
                    self._bound(name, None, value - isinstance(f, D.LessThan))
            elif name in ("manifest", "variable") and isinstance(f, (D.EqualTo, D.EqualNullSafe, D.In)):
                own = set(value) if isinstance(f, D.In) else {value}
                self.equal[name] = self.equal.get(name, own) & own
        return filters

    def _bound(self, axis: str, low: int | None, high: int | None) -> None:
        if low is not None:
            self.low[axis] = max(low, self.low.get(axis, low))
        if high is not None:
            self.high[axis] = min(high, self.high.get(axis, high))

    def partitions(self) -> list[Piece]:
        system, root = _system(self.options["path"])
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for path in sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet")):
            with system.open_input_file(path) as file:
                footer = pq.ParquetFile(file).metadata
            groups, held = [], 0
            for g in range(footer.num_row_groups):
                group = footer.row_group(g)
                if group.num_rows and self._touches(group):
                    groups.append(g)
                    held += group.num_rows
                    if held >= TASK_CHUNKS:
                        out.append(Piece(path, groups))
                        groups, held = [], 0
            if groups:
                out.append(Piece(path, groups))
        return out or [Piece("", [])]

    def _touches(self, group) -> bool:
        """Can the row group hold a chunk that the filters want?  By the least and greatest values in its footer."""
        facts = {}
        for i in range(group.num_columns):
            column = group.column(i)
            if column.is_stats_set and column.statistics.has_min_max:
                facts[column.path_in_schema] = (column.statistics.min, column.statistics.max)
        for axis, low in self.low.items():
            if f"{axis}_last" in facts and facts[f"{axis}_last"][1] < low:
                return False
        for axis, high in self.high.items():
            if f"{axis}_first" in facts and facts[f"{axis}_first"][0] > high:
                return False
        for name, values in self.equal.items():
            if name in facts and not any(facts[name][0] <= v <= facts[name][1] for v in values if v is not None):
                return False
        return True

    # -- reading, in tasks -----------------------------------------------------------------

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.groups:
            return
        system, _ = _system(self.options["path"])
        with system.open_input_file(piece.file) as file:
            rows = pq.ParquetFile(file).read_row_groups(piece.groups)
        chunks = [row for row in rows.to_pylist() if self._wanted(row)]
        chunks.sort(key=lambda row: (row["uri"] or "", row["offset"] or 0))
        fetch, fill = _reader(self.options.get("base")), self.options.get("fillmissing") == "true"
        held: list[dict] = []
        cells = 0
        for row in chunks:
            shape, size = row["shape"], row["size"]
            try:
                data = bytes(row["inline"]) if row["inline"] is not None else fetch(row["uri"], int(row["offset"]), int(row["length"]))
            except FileNotFoundError:
                if not fill:
                    continue
                none = np.nan if row["fill"] is None else row["fill"]
                where, values = _placed(np.full(int(np.prod(size)), none, dtype="float64"), row["idx"], shape, size)
            else:
                where, values = _chunk_cells(data, row["dtype"], row["idx"], shape, size)
            held.append({"row": row, "where": where.astype("int32"), "values": values})
            cells += len(values)
            if cells >= _BATCH_CELLS:
                yield _batch(held)
                held, cells = [], 0
        if held:
            yield _batch(held)

    def _wanted(self, row: dict) -> bool:
        return (
            all(row[f"{a}_last"] >= low for a, low in self.low.items()) and all(row[f"{a}_first"] <= high for a, high in self.high.items())
            and all(row[name] in values for name, values in self.equal.items())
        )


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.replace("file://", "").replace("file:", "")


def _batch(chunks: list[dict]) -> pa.RecordBatch:
    """The cells of decoded chunks; an axis that an array lacks is 0."""
    sizes = [len(c["values"]) for c in chunks]
    own = pa.array(np.repeat(np.arange(len(chunks)), sizes))

    def axis(least: int, at: int) -> pa.Array:
        parts = [c["where"][at] if len(c["where"]) >= least else np.zeros(n, "int32") for c, n in zip(chunks, sizes, strict=True)]
        return pa.array(np.concatenate(parts), pa.int32())

    rest = [x for c, n in zip(chunks, sizes, strict=True) for x in (list(c["where"][2:-2].T) if len(c["where"]) > 4 else [None] * n)]
    named = lambda key, kind: pa.array([c["row"][key] for c in chunks], kind).take(own)
    return pa.RecordBatch.from_arrays([
        named("manifest", pa.string()), named("variable", pa.string()), axis(3, 0), axis(4, 1), axis(2, -2), axis(1, -1),
        pa.array(rest, pa.list_(pa.int32())), named("dims", pa.list_(pa.string())), pa.array(np.concatenate([c["values"] for c in chunks])),
    ], names=["manifest", "variable", *AXES, "rest", "dims", "raw"])
