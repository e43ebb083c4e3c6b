"""Best-fit packing of documents into sequences, under conflicts.

Bins are ordered by the room they have left.  Each carries a bitmap of its sources and one of
its duplicate clusters; a piece may not join a bin that holds its source or its cluster.
Pieces come in falling size; the search starts at the tightest bin that has room and goes on to
its successors until one is compatible; if none is, a bin is opened.

Documents are dealt at random into blocks of bounded size, and a block is packed as a whole.
Only numbers are shuffled, never texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_of, with_row_key
from .jaccard import near_rows

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces of a block.
BLOCK = 4096


class Bins:
    """Open bins by residual; ``levels[r]`` holds [bitmap of sources, bitmap of clusters, bin] of residual ``r``."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.levels: dict[int, list[list[int]]] = {}
        self.used = 0  # bit r: some bin has residual r
        self.common: dict[int, tuple[int, int]] = {}  # bits that all bins of a level have

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece; ``source`` and ``cluster`` are single bits or 0."""
        ahead = self.used >> size
        residual = size
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            residual += step
            every = self.common[residual]
            if not (every[0] & source or every[1] & cluster):
                level = self.levels[residual]
                for i, held in enumerate(level):
                    if not (held[0] & source or held[1] & cluster):
                        level.pop(i)
                        self._settle(residual)
                        return self._put(held, residual, size, source, cluster)
            ahead >>= step + 1
            residual += 1
        self.count += 1
        return self._put([0, 0, self.count - 1], self.capacity, size, source, cluster)

    def _put(self, held: list[int], residual: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        held[0] |= source
        held[1] |= cluster
        left = residual - size
        if left:
            level = self.levels.setdefault(left, [])
            self.common[left] = tuple(a & b for a, b in zip(self.common[left], held, strict=False)) if level else (held[0], held[1])
            level.append(held)
            self.used |= 1 << left
        return held[2], self.capacity - residual

    def _settle(self, residual: int) -> None:
        level = self.levels[residual]
        if not level:
            self.used &= ~(1 << residual)
            return
        a, b = level[0][0], level[0][1]
        for held in level[1:]:
            if not (a or b):
                break
            a, b = a & held[0], b & held[1]
        self.common[residual] = (a, b)


def pack_block(sizes, sources, clusters, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece of a block.  Null sources and clusters conflict with nothing."""
    bit: dict = {}
    source_bit = [0 if s is None else 1 << bit.setdefault(s, len(bit)) for s in sources]
    seen: dict = {}
    for c in clusters:
        if c is not None:
            seen[c] = seen.get(c, 0) + 1
    twice = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1)}  # others cannot conflict
    cluster_bit = [1 << twice[c] if c in twice else 0 for c in clusters]
    bins, out = Bins(capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.place(sizes[i], source_bit[i], cluster_bit[i])
    return out


def cluster_key(text_col: str = "text"):
    """Names texts that are the same but for case, digits, punctuation and white space."""
    return F.xxhash64(F.regexp_replace(F.lower(text_of(text_col)), r"[^\p{L}]+", " "))


def tokens(text_col: str = "text"):
    """Words of the whole text and one token for its end."""
    return F.size(F.filter(F.split(text_of(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    capacity: int = CAPACITY, block: int = BLOCK, near: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, offset): where each piece of each row lies.

    A document of more than ``capacity`` tokens is cut into full pieces, which fill bins of
    their own, and a rest; ``start`` is the piece's first token in its document.  An empty or
    null text has one token.  A cluster holds the texts of one ``cluster_key``; with ``near`` it is a
    component of near-duplicates (a Jaccard similarity of at least 0.8 over five-word shingles)
    and of texts with the same letters, if any.  Rows that repeat an id are packed each for itself; being of one
    cluster they never share a bin.
    """
    # written once, so that the numbers of its rows are fixed
    if near:
        named = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
        rows = near_rows(with_row_key(named, "f", "i"), "id", letters=True, more=["source"])
        rows = rows.select("id", "source", F.col("root").alias("cluster"), (F.col("words") + 1).cast("int").alias("n"))
        rows = rows.withColumn("row", F.monotonically_increasing_id())
    else:
        rows = docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), cluster_key(text_col).alias("cluster"), tokens(text_col).alias("n")
        )
        rows = settle(rows, "packing-items").withColumn("row", F.monotonically_increasing_id())
    count = rows.count()
    blocks = -(-count // block) or 1
    full = F.floor(F.col("n") / capacity).cast("int")
    whole = rows.filter(F.col("n") >= capacity).select(
        "id", "row", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece")
    ).select(
        "id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).alias("length"),
        F.concat_ws("-", F.lit("w"), F.col("row"), F.col("piece")).alias("bin_id"), F.lit(0).alias("offset"),
    )
    rest = rows.filter(F.col("n") % capacity != 0).select(
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row", "id", "source", "cluster", full.alias("piece"),
        (F.col("n") % capacity).cast("int").alias("length"),
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        sources = [None if s is None or s != s else s for s in pdf["source"]]
        placed = pack_block(pdf["length"].tolist(), sources, pdf["cluster"].tolist(), capacity)
        at = pdf["block"].iloc[0]
        return pd.DataFrame({
            "id": pdf["id"], "piece": pdf["piece"], "start": pdf["piece"].astype("int64") * capacity, "length": pdf["length"],
            "bin_id": [f"b-{at}-{b}" for b, _ in placed], "offset": [o for _, o in placed],
        })

    kind = docs.schema[id_col].dataType.simpleString()
    packed = rest.groupBy("block").applyInPandas(run, f"id {kind}, piece int, start long, length int, bin_id string, offset int")
    return whole.unionByName(packed).withColumnRenamed("id", id_col)
