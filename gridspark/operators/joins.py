"""Joins against catalogue-sized tables, and the checkpoint that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in rows, that is ever broadcast.
BROADCAST_ROWS = 500_000


def at_most(df: DataFrame, rows: int) -> bool:
    """Does ``df`` have at most ``rows`` rows?  Counts no further than that."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its row count allows, else unchanged.

    Without the hint Spark joins by shuffling, and adaptive execution splits
    skewed keys.
    """
    return F.broadcast(df) if at_most(df, max_rows) else df


def lookup_join(
    big: DataFrame, small: DataFrame, on, how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a fact table with a table that is usually, but not surely, small."""
    return big.join(sized_broadcast(small, max_rows), on, how)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where NULL equals NULL; the columns of ``on`` are those of ``left``."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(renamed[f"_right_{c}"])
    return left.join(renamed, match, how).drop(*[f"_right_{c}" for c in on])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder of the cluster; a scratch one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
