"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import scratch_path

#: Characters of text that one numpy pass holds at once (a longer text makes a pass of its own).
CHUNK_CHARS = 1_000_000


#: Rows of a batch of texts on its way to Python; whole texts are long, so batches are short.
BATCH_ROWS = 1000


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Later steps depend on files that every executor sees, not on the tasks that made them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (names are case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text (0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def short_batches(spark) -> None:
    """Let Arrow batches of the session hold ``BATCH_ROWS`` rows at most: this bounds a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory of this worker to the system; workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[list[bytes]]:
    """Values of a binary column over several batches, in lists of about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        for value in b.column(column):
            held.append(value.as_py())
            size += len(held[-1])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def chunks(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows whose sizes sum to ``limit`` at most (one row at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def batch_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_SCAN_NODES = {"Project", "SubqueryAlias", "LogicalRelation", "Filter"}


def _plain_scan(docs: DataFrame) -> bool:
    """Is ``docs`` a file scan (columns chosen and rows filtered at most), whose files name each row?"""
    plan = getattr(docs, "_jdf", None)
    if plan is None or "_metadata" in docs.columns:
        return False
    todo = [plan.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in _SCAN_NODES or not node.deterministic():
            return False
        kids = node.children()
        todo.extend(kids.apply(i) for i in range(kids.size()))
    return True


def with_row_key(docs: DataFrame, file_col: str, at_col: str) -> DataFrame:
    """``docs`` with two longs that name each row, the same however often the rows are read.

    A row of a file scan is named by its file and its place in it; other inputs are written first.
    """
    if _plain_scan(docs):
        try:
            named = docs.withColumns({file_col: F.xxhash64("_metadata.file_path"), at_col: F.col("_metadata.row_index")})
            return named if named.schema else docs
        except AnalysisException:
            pass  # a format without row numbers
    return settle(docs.withColumns({file_col: F.lit(0).cast("long"), at_col: F.monotonically_increasing_id()}), "numbered-rows")


#: Bytes, counted, up to which row keys and short lists are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16_000_000


def light(df: DataFrame, *lists: str) -> DataFrame:
    """``df``, a settled table of a few longs and of ``lists``, with a broadcast hint if its counted size is within ``BROADCAST_BYTES``."""
    entries = sum((F.size(c) for c in lists), F.lit(0))
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(entries), F.lit(0))).first()
    return F.broadcast(df) if 64 * rows + 16 * total <= BROADCAST_BYTES else df
