"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links(u, v)`` but the roots; the root is the smallest node reachable.

    Each step keeps at most one link per node and known neighbour, so nothing grows with the
    square of a component; the number of steps grows with the logarithm of its length.
    Neighbour minima are partial aggregates; the joins of hot nodes are left to AQE.
    """
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()
    links = settle(links, "links")
    state = _state(links)
    while state[0]:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        before, links = links, settle(
            small.select("hi", F.col("m").alias("lo"))
            .unionByName(small.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
            .distinct(),
            "links",
        )
        discard(before)
        now = _state(links)
        if now == state:
            break
        state = now
    roots = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots.settled_at = links.settled_at
    return roots
