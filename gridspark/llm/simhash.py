"""SimHash near-duplicates: 64-bit fingerprints and a binary-trie self-join.

Two fingerprints link when they differ in at most ``budget`` bits.  With three errors, one of
four quarters of the bits is free of errors, so each fingerprint is dealt out four times, by
the value of each quarter.  What shares a quarter forms a binary trie over its bits; the trie
is joined with itself: pairs of nodes go down together, differing bits are counted, and a pair
is dropped as soon as its count exceeds the budget.  The links that a task finds are reduced to
a spanning forest, then connected across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, fresh, give_back, light, settle, short_batches, text_of, with_row_key
from .components import components
from .jaccard import near_rows

SHINGLE = 3
BUDGET = 3
SEED = 42
#: Fingerprints that share a quarter and are joined in one task; larger groups are split.
GROUP = 200_000
#: Node pairs that one step of the trie join holds.
FRONTIER = 1_000_000

_FULL = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one UTF-8 text; zero if it has no words.  Works on the whole text."""
    words = text.lower().split()  # bytes: A-Z and \\x20, \\x09-\\x0D only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, more: list[str] | None = None
) -> DataFrame:
    """(id, fp, ...) of every row; ``fp`` is the fingerprint as a signed long.  Null text is empty.  ``more`` are columns of longs."""
    more = more or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield batch_of({"id": b.column(0), "fp": pa.array(fps.view(np.int64))} | {c: b.column(2 + i) for i, c in enumerate(more)})
        give_back()

    short_batches(docs.sparkSession)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("t"), *more).mapInArrow(
        run, ", ".join(["id long", "fp long", *[f"{c} long" for c in more]])
    )


def trie_links(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> Iterator[tuple]:
    """Pairs of positions, inside the same group, that differ in at most ``budget`` bits.

    ``fps`` (uint64) ascends inside every group ``[start, end)``; each group is a trie whose
    nodes are ranges.  A node splits where the ones of the next bit begin.  Pairs of single
    leaves are settled at once (paths without branches are compressed).
    """
    ones: dict[int, np.ndarray] = {}

    def cut(bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        return hi - (ones[bit][hi] - ones[bit][lo])

    keep = ends - starts > 1
    s, e = starts[keep].astype(np.int64), ends[keep].astype(np.int64)
    stack = [(63, s, e, s, e, np.zeros(len(s), np.int8))]
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack.append((bit, *(x[half:] for x in (a0, a1, b0, b1, err))))
            a0, a1, b0, b1, err = (x[:half] for x in (a0, a1, b0, b1, err))
            stack.append((bit, a0, a1, b0, b1, err))
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= budget
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, err = (x[~leaf] for x in (a0, a1, b0, b1, err))
        if not len(a0) or bit < 0:
            continue
        am, bm, own = cut(bit, a0, a1), cut(bit, b0, b1), a0 == b0
        other = ~own
        more = (err + 1).astype(np.int8)
        kids = [
            np.concatenate(x)
            for x in zip(
                (a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, more),
                (am[other], a1[other], b0[other], bm[other], more[other]), strict=True,
            )
        ]
        k0, k1, l0, l1, kerr = kids
        alive = (k1 > k0) & (l1 > l0) & (kerr <= budget) & ~((k0 == l0) & (k1 - k0 == 1))
        if alive.any():
            stack.append((bit - 1, *(x[alive] for x in kids)))


def local_roots(n: int, pairs: Iterator[tuple]) -> np.ndarray:
    """Smallest connected position of each of ``n`` positions."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _link_groups(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        mask = np.concatenate([p[0] for p in parts]).view(np.uint64)
        fp = np.concatenate([p[1] for p in parts]).view(np.uint64)
        value = fp & mask
        order = np.lexsort((fp, value, mask))
        mask, value, fp = mask[order], value[order], fp[order]
        first = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))))
        distinct, node = np.unique(fp, return_inverse=True)
        found = trie_links(fp, first, np.append(first[1:], len(fp)), budget)
        root = local_roots(len(distinct), ((node[i], node[j]) for i, j in found))
        at = np.flatnonzero(root != np.arange(len(root)))
        yield batch_of({"u": pa.array(distinct[at].view(np.int64)), "v": pa.array(distinct[root[at]].view(np.int64))})
        give_back()

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _submasks(mask: int, pieces: int) -> list[int]:
    """``mask`` joined with each of ``pieces`` runs of the bits that it leaves free."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [len(free) * i // pieces for i in range(pieces + 1)]
    runs = [free[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return [mask | sum(1 << b for b in run) for run in runs]


def quarters(fps: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """(mask, fp): every fingerprint once for each run of bits that must agree.

    A group of more than ``group`` fingerprints with equal bits under its mask is split by
    runs of its free bits in the same way, again and again; as each step fixes a quarter of
    the free bits, after five steps no group can exceed 2 ** 16.
    """

    def dealt(df: DataFrame, masks: list[int]) -> DataFrame:
        table = [
            x for m in masks
            for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(x)).cast("long") for x in _submasks(m, budget + 1)]))
        ]
        choices = F.create_map(*table)[F.col("mask")]
        return df.select(F.explode(choices).alias("mask"), "fp")

    masks = [0]
    rows = dealt(fps.select(F.lit(0).cast("long").alias("mask"), "fp"), masks)
    for _ in range(5):
        masks = sorted({x for m in masks for x in _submasks(m, budget + 1)})
        value = F.col("mask").bitwiseAND(F.col("fp"))
        big = rows.groupBy("mask", value.alias("value")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group)
        big = settle(big.select("mask", "value"), "big-groups")
        if big.isEmpty():
            break
        rows = rows.withColumn("value", value)
        on = ["mask", "value"]
        split = dealt(rows.join(big, on, "left_semi"), masks)
        rows = settle(rows.join(big, on, "left_anti").select("mask", "fp").unionByName(split), "quarters")
    return rows


def near_links(fps: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fps(fp)``, a spanning forest per task."""
    rows = quarters(fps, budget, group)
    return rows.repartition(F.col("mask"), F.col("mask").bitwiseAND(F.col("fp"))).mapInArrow(
        _link_groups(budget), "u long, v long"
    )


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, budget: int = BUDGET, group: int = GROUP,
) -> DataFrame:
    """(id, fp, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own included; null ids
    are passed over (a component of null ids only has none).  Documents without words share
    the fingerprint zero and link like any other.  No rows give no rows.
    """
    marked = settle(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = _classes(marked, budget, group).select("fp", "component_id")
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _classes(marked: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of ``marked(id, fp)``."""
    known = marked.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(near_links(known.select("fp"), budget, group))
    known = known.join(roots, known["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    named = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return known.select("fp", "root").join(named, "root").select("fp", "root", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def drop_linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document per component of linked fingerprints (:func:`near_groups`): the one with the smallest id.

    Repeated rows of the smallest id count as one document (any of them stays); rows without an id stay.
    """
    file, at = fresh(docs, "_file"), fresh(docs, "_at")
    keyed = with_row_key(docs, file, at)
    own = keyed.select(F.col(file).alias("f"), F.col(at).alias("i"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = settle(fingerprints(own, "id", more=["f", "i"]), "fingerprints")
    rows = marked.join(settle(_classes(marked).select("fp", "root"), "near-classes"), "fp")
    return _drop_but_heads(docs, keyed, file, at, rows)


def _drop_but_heads(docs: DataFrame, keyed: DataFrame, file: str, at: str, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows (f, i, id, root) that do not head their component; rows without an id stay."""
    rows = rows.filter("id is not null").select("root", F.struct("id", "f", "i").alias("own"))
    heads = rows.groupBy("root").agg(F.min("own").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "head")
    heads = settle(heads, "near-heads")  # written, so that a hot component is split when it is joined
    lost = rows.join(heads, "root").filter("own <> head").select(F.col("own.f").alias(file), F.col("own.i").alias(at))
    return keyed.join(light(settle(lost, "near-copies")), [file, at], "left_anti").select(*docs.columns)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document per component: the one with the smallest id.

    Links are pairs of a Jaccard similarity of at least 0.8 over five-word shingles (see
    :mod:`.jaccard`), not fingerprints: pairs of that similarity differ in up to a quarter of
    64 bits, and with such a budget no run of bits would divide the rows.  Repeated rows of
    the smallest id count as one document (any of them stays); rows without an id stay.
    """
    file, at = fresh(docs, "_file"), fresh(docs, "_at")
    keyed = with_row_key(docs, file, at)
    own = keyed.select(F.col(file).alias("f"), F.col(at).alias("i"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _drop_but_heads(docs, keyed, file, at, near_rows(own, "id"))
