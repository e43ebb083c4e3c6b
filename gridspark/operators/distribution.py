"""Histogram and empirical distribution of finite cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decode import finite_value
from .joins import cut_lineage, lookup_join, null_safe_join
from .ordered import running_sum

_RUN = 100_000


def cdf(df: DataFrame, by: list[str]) -> DataFrame:
    """Sorted finite values with ``(i + 1) * 100 / n``, one row per cell, ties included.

    Cells are counted per distinct value first (partial aggregation absorbs ties), the
    distinct values are summed up in range-partitioned blocks, and only then expanded
    back, long runs of ties in pieces.
    """
    x = finite_value()
    counts = df.filter(x.isNotNull()).groupBy(*by, x.alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    summed = running_sum(counts, by, [F.col("value")], "_n", "_upto")
    totals = summed.groupBy(*by).agg(F.sum("_n").alias("_total"))
    placed = null_safe_join(summed, totals, by) if by else summed.withColumn("_total", totals.select("_total").scalar())
    before = F.col("_upto") - F.col("_n")
    pieces = placed.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / _RUN))))
    longest = summed.agg(F.max("_n")).first()[0]
    if longest is not None and longest > _RUN:
        # one value may stand for most cells; its pieces go to different tasks
        pieces = pieces.repartition(*by, "value", "_piece")
    low = before + F.col("_piece") * _RUN + 1
    high = F.least(low + _RUN - 1, F.col("_upto"))
    rank = pieces.withColumn("rank", F.explode(F.sequence(low, high)))
    return rank.select(*by, "value", "rank", (F.col("rank") * 100.0 / F.col("_total")).alias("percent"))


def bin_count(n, span):
    """Number of bins: ``ceil(log2 n) + 1`` kept in 1..12, one when all values are equal."""
    k = F.ceil(F.log2(n.cast("double"))) + 1
    return F.when(span > 0, F.least(F.greatest(k, F.lit(1)), F.lit(12))).otherwise(F.lit(1)).cast("int")


def histogram(df: DataFrame, by: list[str], density: bool = False) -> DataFrame:
    """Equal-width histogram of the finite cells of each group, empty bins included.

    One pass finds n, min and max per group; the second counts (group, bin) pairs with
    partial aggregation, so a hot group costs no more than its share of the scan.
    """
    x = finite_value()
    rows = df.select(*by, x.alias("_x")).filter("_x IS NOT NULL")
    facts = rows.groupBy(*by).agg(F.count("_x").alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    facts = facts.withColumn("_k", bin_count(F.col("n"), span)).withColumn(
        "_width", F.when(span > 0, span / F.col("_k")).otherwise(F.lit(1.0))
    )
    facts = cut_lineage(facts)  # one row per group, used three times
    place = F.when(
        F.col("_hi") > F.col("_lo"),
        F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_width")), F.col("_k") - 1),
    ).otherwise(F.lit(0)).cast("int")
    if by:
        tagged = lookup_join(rows, facts, by, "inner")
    else:
        one = facts.select(F.struct("*").alias("_f")).scalar()
        tagged = rows.withColumn("_f", one).select("_x", "_f.*")
    counts = tagged.groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("_count"))
    bins = facts.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    count = F.coalesce("_count", F.lit(0))
    height = count * 100.0 / F.col("n") if density else count.cast("double")
    low = F.col("_lo") + F.col("bin") * F.col("_width")
    return bins.join(counts, [*by, "bin"], "left").select(
        *by, "bin", low.alias("bin_low"), (low + F.col("_width")).alias("bin_high"),
        count.alias("count"), height.alias("height"),
    )


def ordered_points(df: DataFrame, by: list[str]) -> DataFrame:
    """Distribution points in display order."""
    return cdf(df, by).orderBy(*by, "rank")


