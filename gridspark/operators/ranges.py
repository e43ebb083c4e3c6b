"""Byte ranges: validation and coalescing of adjacent ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GridError
from .joins import cut_lineage, lookup_join
from .ordered import dense_order, running_sum, with_neighbours

#: Longest chain of adjacent ranges that is merged inside one row.
CHAIN_ROWS = 50_000
#: Ranges of a chain that are folded before what is finished is put away.
PIECE = 256


def validate_ranges(ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Ranges that violate ``0 <= start <= end <= size``, with the reason.

    ``ranges``: object, start, end; ``sizes``: object, size.
    """
    joined = lookup_join(ranges, sizes, ["object"])
    reason = (
        F.when(F.col("size").isNull(), "object is unknown")
        .when(F.col("start") > F.col("end"), "range ends before it starts")
        .when((F.col("start") < 0) | (F.col("end") > F.col("size")), "range is outside the object")
    )
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select("object", "start", "end", "reason")


def coalesce_ranges(ranges: DataFrame, cap: int) -> DataFrame:
    """Merge exactly adjacent ranges of an object while the result stays within ``cap``.

    Greedy from the left, as a sequential fold would do.  Ranges are first split into
    chains (a chain ends where the next range does not start at its end), which are
    independent.  Short chains are folded inside one row; a chain too long for one row
    is solved by pointer doubling over joins, so one huge object needs no single task.
    """
    if cap <= 0:
        raise GridError("maximum request size is zero")
    linked = with_neighbours(ranges, ["object"], [F.col("start"), F.col("end")], previous={"end": "_prev_end"})
    flagged = linked.withColumn("_new", F.when(F.col("start").eqNullSafe(F.col("_prev_end")), 0).otherwise(1))
    chained = cut_lineage(
        running_sum(
            flagged, ["object"], [F.col("start"), F.col("end"), F.col("_new").desc()], "_new", "_chain"
        ).select(
            "object", "start", "end", "_chain"
        )
    )
    sizes = chained.groupBy("object", "_chain").agg(F.count(F.lit(1)).alias("_rows"))
    long_ones = sizes.filter(F.col("_rows") > CHAIN_ROWS).select("object", "_chain")
    if long_ones.isEmpty():
        return _fold(chained, cap)
    short = lookup_join(chained, long_ones, ["object", "_chain"], "left_anti")
    hot = lookup_join(chained, long_ones, ["object", "_chain"], "left_semi")
    return _fold(short, cap).unionByName(_double(hot, cap))


def _fold(chained: DataFrame, cap: int) -> DataFrame:
    """One row per chain, folded by higher-order functions, ``PIECE`` ranges at a time.

    What is finished inside a piece is appended range by range, finished pieces as a whole, so
    that appending copies short arrays only.
    """
    rows = chained.groupBy("object", "_chain").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_r"))
    kind = "array<struct<start:bigint,end:bigint>>"
    none = F.lit(None).cast("bigint")
    open_ = lambda acc: F.struct(acc["start"].alias("start"), acc["end"].alias("end"))

    def state(pieces, done, start, end):
        return F.struct(pieces.alias("pieces"), done.alias("done"), start.alias("start"), end.alias("end"))

    def step(acc, r):
        grows = (acc["end"] == r["start"]) & (r["end"] - acc["start"] <= cap)
        return (
            F.when(acc["start"].isNull(), state(acc["pieces"], acc["done"], r["start"], r["end"]))
            .when(grows, state(acc["pieces"], acc["done"], acc["start"], r["end"]))
            .otherwise(state(acc["pieces"], F.concat(acc["done"], F.array(open_(acc))), r["start"], r["end"]))
        )

    def piece(acc, ranges):
        close = lambda s: state(F.concat(s["pieces"], F.array(s["done"])), F.array().cast(kind), s["start"], s["end"])
        return F.aggregate(ranges, acc, step, close)

    count = F.ceil(F.size("_r") / PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("_r", i * PIECE + 1, F.lit(PIECE)))
    first = state(F.array().cast(f"array<{kind}>"), F.array().cast(kind), none, none)
    merged = F.aggregate(pieces, first, piece, lambda acc: F.concat(F.flatten(acc["pieces"]), F.array(open_(acc))))
    return rows.select("object", F.explode(merged).alias("_m")).select("object", "_m.start", "_m.end")


def _double(chained: DataFrame, cap: int) -> DataFrame:
    """Block starts of long chains by pointer doubling.

    A block that starts at row i ends before the first row whose end exceeds
    ``start_i + cap`` (never before i + 1).  That row is found for all i at once by
    sorting starts and ends into one sequence and carrying the last end seen; following
    these pointers from the head of a chain visits exactly the greedy block starts.
    """
    rows = cut_lineage(
        dense_order(chained, F.col("object"), F.col("_chain"), F.col("start"), F.col("end"), name="_i")
    )
    # ends at or below start_i + cap, counted in one merged order, give the next start
    ends = rows.select("object", "_chain", F.col("end").alias("_at"), F.lit(0).alias("_kind"), "_i", F.lit(1).alias("_is_end"))
    asks = rows.select(
        "object", "_chain", (F.col("start") + cap).alias("_at"), F.lit(1).alias("_kind"), "_i", F.lit(0).alias("_is_end")
    )
    merged = running_sum(
        ends.unionByName(asks), ["object", "_chain"], [F.col("_at"), F.col("_kind"), F.col("_i")], "_is_end", "_passed"
    ).filter("_kind = 1")
    heads = rows.groupBy("object", "_chain").agg(F.min("_i").alias("_head"), F.count(F.lit(1)).alias("_n"))
    nxt = lookup_join(merged.select("object", "_chain", "_i", "_passed"), heads, ["object", "_chain"], "inner").select(
        "_i", F.greatest(F.col("_head") + F.col("_passed"), F.col("_i") + 1).alias("_to"), (F.col("_head") + F.col("_n")).alias("_stop")
    )
    jump = cut_lineage(nxt.select("_i", F.when(F.col("_to") < F.col("_stop"), F.col("_to")).alias("_to")).filter("_to IS NOT NULL"))
    marked = cut_lineage(heads.select(F.col("_head").alias("_i")))
    jumps = [jump]
    while True:
        last = jumps[-1]
        twice = last.join(last.select(F.col("_i").alias("_to"), F.col("_to").alias("_far")), "_to").select(
            "_i", F.col("_far").alias("_to")
        )
        twice = cut_lineage(twice)
        if twice.isEmpty():
            break
        jumps.append(twice)
    for j in reversed(jumps):
        marked = cut_lineage(marked.unionByName(marked.join(j, "_i").select(F.col("_to").alias("_i"))).distinct())
    tagged = rows.join(marked.withColumn("_begin", F.lit(1)), "_i", "left").withColumn("_begin", F.coalesce("_begin", F.lit(0)))
    numbered = running_sum(tagged, [], [F.col("_i")], "_begin", "_block_no")
    return numbered.groupBy("object", "_block_no").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(
        "object", "start", "end"
    )
