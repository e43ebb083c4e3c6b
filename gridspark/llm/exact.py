"""Exact deduplication through an extendible-hash index on shared files.

The index is a Parquet folder below the shared checkpoint folder.  Every document has one
entry: 64-bit hash, SHA-256, length, id.  A directory maps the leading bits of the hash to
buckets; a bucket that holds more entries than ``capacity`` is split on its next bit, which
doubles the directory there, until it fits or its local depth reaches ``max_depth``.  Entries
are dealt to owner tasks by bucket.  Inside a bucket entries of equal hash form a chain; the
texts of chains longer than one entry are compared byte by byte, by grouping on the text.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import at_most
from .common import fresh, settle, text_of

#: Entries that a bucket holds before it is split.
CAPACITY = 1_000_000
#: Deepest directory: at most 2 ** MAX_DEPTH rows, which bounds its broadcast (a few MB).
MAX_DEPTH = 14
#: Chains whose keys (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_CHAINS = 1_000_000


def _cell(hash_col: Column, depth: int) -> Column:
    """The first ``depth`` bits of the hash."""
    return F.shiftrightunsigned(hash_col, 64 - depth).cast("int")


def directory(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(cell, bucket, local_depth) for each cell of ``max_depth`` leading bits that holds entries.

    The local depth of a cell is the smallest depth at which the bucket around it holds at
    most ``capacity`` entries, or ``max_depth``.  A bucket is named by its prefix, with a
    leading one bit for its depth.  At most ``2 ** max_depth`` rows exist.
    """
    cells = entries.groupBy(_cell(F.col("h"), max_depth).alias("cell")).agg(F.count(F.lit(1)).alias("n")).coalesce(1)
    depth = F.lit(max_depth)
    for d in range(max_depth - 1, -1, -1):  # one task: the directory is bounded, and needs no exchange
        prefix = F.shiftright(F.col("cell"), max_depth - d)
        cells = cells.withColumn(f"n{d}", F.sum("n").over(Window.partitionBy(prefix)))
        depth = F.when(F.col(f"n{d}") <= capacity, d).otherwise(depth)
    # the smallest depth that fits: conditions of small depths are tested first
    return cells.select("cell", depth.alias("local_depth")).select(
        "cell", "local_depth",
        F.expr(f"shiftleft(1, local_depth) + shiftright(cell, {max_depth} - local_depth)").alias("bucket"),
    )


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """The index files: (bucket, h, sha, len, id, row), one entry per row of ``docs``.

    ``row`` numbers the entries; it is fixed once written, so it tells repeated rows apart.
    """
    text = text_of(text_col)
    raw = settle(
        docs.select(
            F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("sha"),
            F.octet_length(text).cast("long").alias("len"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "hash-entries",
    )
    cells = F.broadcast(directory(raw, capacity, max_depth))
    placed = raw.withColumn("cell", _cell(F.col("h"), max_depth)).join(cells, "cell").drop("cell")
    # by bucket; a bucket that one hot hash overfills is cut into several files
    return settle(placed.hint("rebalance", "bucket"), "hash-index")


def chains(index: DataFrame) -> DataFrame:
    """Hashes that more than one entry has (owner tasks count their key ranges)."""
    return index.groupBy("bucket", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")


def compare_bytes(docs: DataFrame, chained: DataFrame, text_col: str = "text") -> DataFrame:
    """Classes of equal texts (h, sha, size) among the chained documents.

    Grouping by the text itself compares its bytes.  Partial aggregation leaves one text per
    class and task, however many copies there are.
    """
    keys = F.broadcast(chained) if at_most(chained, BROADCAST_CHAINS) else chained
    texts = docs.select(F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("t"))
    classes = texts.join(keys, "h", "left_semi").groupBy("h", "t").agg(F.count(F.lit(1)).alias("size"))
    return classes.select("h", F.sha2("t", 256).alias("sha"), "size")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Of equal texts the row with the largest id stays; of rows that repeat text and id, one.
    Null text counts as empty; a null id is smaller than any other; no rows give no rows.
    """
    index = build_index(docs, id_col, text_col, capacity, max_depth)
    chained = settle(chains(index), "hash-chains")
    sizes = compare_bytes(docs, chained, text_col)
    # SHA-256 names a class of compared bytes inside its chain
    best = index.join(F.broadcast(chained) if at_most(chained, BROADCAST_CHAINS) else chained, "h", "left_semi")
    best = best.groupBy("h", "sha").agg(F.max(F.struct("id", "row")).alias("top"))
    groups = settle(best.join(sizes, ["h", "sha"]), "hash-groups")
    lookup = F.broadcast(groups) if at_most(groups, BROADCAST_CHAINS // 4) else groups
    out = index.join(lookup, ["h", "sha"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("top").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("top").isNull() | (F.col("top.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops; columns as they were.

    Dropped rows are few or many, so they are counted before they are broadcast.
    """
    groups = settle(exact_groups(docs, id_col, text_col), "exact-groups")
    multi = groups.filter("group_size > 1")
    # rows to drop: not the kept id of their class
    key, sha, drop = (fresh(docs, c) for c in ("_key", "_sha", "_drop"))
    lost = multi.filter(~F.col(id_col).eqNullSafe(F.col("keep_id"))).select(
        F.col(id_col).alias(key), F.col("text_sha256").alias(sha), F.lit(True).alias(drop)
    ).distinct()
    lost = F.broadcast(lost) if at_most(lost, BROADCAST_CHAINS // 4) else lost
    match = docs[id_col].eqNullSafe(lost[key]) & (F.sha2(text_of(text_col), 256) == lost[sha])
    out = docs.join(lost, match, "left_anti")
    # the kept id itself may be repeated: one of its rows stays
    twice = multi.filter(F.col(id_col).eqNullSafe(F.col("keep_id"))).groupBy(
        F.col(id_col).alias(key), F.col("text_sha256").alias(sha)
    ).agg(F.count(F.lit(1)).alias(drop)).filter(F.col(drop) > 1)
    if twice.isEmpty():
        return out
    again = out[id_col].eqNullSafe(twice[key]) & (F.sha2(text_of(text_col), 256) == twice[sha])
    single = out.join(twice, again, "left_anti")
    copies = out.join(twice, again, "left_semi").withColumn(sha, F.sha2(text_of(text_col), 256))  # null and empty are one text
    return single.unionByName(copies.dropDuplicates([id_col, sha]).drop(sha))
