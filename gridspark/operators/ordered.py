"""Row numbers, neighbours and prefix sums that survive a huge group.

A window function sorts each group in one task.  When the input is large, these
functions range-partition the rows by the whole sort key instead, number them inside
each partition, and add the sizes of the preceding partitions (one row per partition).
A group that holds most of the data is then spread over many tasks.  An input whose groups
are all counted to be small takes the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import cut_lineage, null_safe_join

_LOCAL_BITS = 33  # monotonically_increasing_id(): partition number above, position below
#: Rows that one window may hold.
BLOCK = 100_000


def _settle(df: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, bool]:
    """Compute the input once, and tell whether all of it, or each of its groups ``by``, fits one window."""
    rows = cut_lineage(df)
    if rows.count() <= BLOCK:
        return rows, True
    return rows, bool(by) and rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK).isEmpty()


def _spread(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Dense 0-based positions by range partitions; the positions are fixed data."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mid", _LOCAL_BITS)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_part", "_before", "_mid")
    )


def dense_order(df: DataFrame, *order: Column, name: str = "_g") -> DataFrame:
    """Add a dense 0-based position of every row in the total order ``order``."""
    rows, small = _settle(df)
    if small:
        return rows.coalesce(1).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    return _spread(rows, list(order), name)


def number_rows(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based ``row_number`` over ``by`` ordered by ``order``."""
    if not by:
        return dense_order(df, *order, name="_g").withColumn(name, F.col("_g") + 1).drop("_g")
    rows, small = _settle(df, by)
    if small:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn(name, F.row_number().over(w).cast("bigint"))
    placed = _spread(rows, [*[F.col(b) for b in by], *order], "_g")
    firsts = placed.groupBy(*by).agg(F.min("_g").alias("_first"))
    out = null_safe_join(placed, firsts, by)
    return out.withColumn(name, F.col("_g") - F.col("_first") + 1).drop("_g", "_first")


def with_neighbours(
    df: DataFrame, by: list[str], order: list[Column],
    previous: dict[str, str] | None = None, following: dict[str, str] | None = None,
) -> DataFrame:
    """Add columns of the previous and of the next row of the group (NULL at its ends).

    Both arguments map source column to result column.  A large input is laid out in
    blocks of fixed size and each block also receives the one row before and after it, so
    no window sees more than ``BLOCK + 2`` rows.
    """
    shifts = ((F.lag, previous or {}), (F.lead, following or {}))
    rows, small = _settle(df, by)
    if small:
        w = Window.partitionBy(*by).orderBy(*order)
        out = rows
        for shift, columns in shifts:
            for source, result in columns.items():
                out = out.withColumn(result, shift(F.col(source)).over(w))
        return out
    placed = _spread(rows, [*[F.col(b) for b in by], *order], "_g")
    block = F.floor(F.col("_g") / BLOCK)
    last = (F.col("_g") % BLOCK) == BLOCK - 1
    first = (F.col("_g") % BLOCK) == 0
    homes = F.when(last, F.array(block, block + 1)).when(first, F.array(block, block - 1)).otherwise(F.array(block))
    out = placed.withColumn("_block", F.explode(homes)).withColumn("_own", F.col("_block") == block)
    w = Window.partitionBy("_block").orderBy("_g")
    for shift, columns in shifts:
        same = F.lit(True)
        for b in by:
            same = same & shift(F.col(b)).over(w).eqNullSafe(F.col(b))
        for source, result in columns.items():
            out = out.withColumn(result, F.when(same, shift(F.col(source)).over(w)))
    return out.filter("_own").drop("_g", "_block", "_own")


def running_sum(
    df: DataFrame, by: list[str], order: list[Column], column: str, name: str
) -> DataFrame:
    """Inclusive prefix sum of ``column`` inside each group."""
    rows, small = _settle(df, by)
    if small:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum(column).over(w))
    placed = _spread(rows, [*[F.col(b) for b in by], *order], "_g").withColumn("_block", F.floor(F.col("_g") / BLOCK))
    keys = [*by, "_block"]
    inside = Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(*keys).agg(F.sum(column).alias("_total"))
    # one row per group and block
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_carry", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    return (
        null_safe_join(placed.withColumn("_part", F.sum(column).over(inside)), carried, keys)
        .withColumn(name, F.col("_part") + F.col("_carry"))
        .drop("_part", "_carry", "_block", "_g")
    )
