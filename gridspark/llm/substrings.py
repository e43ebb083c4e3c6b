"""Substring deduplication by prefix-partitioned suffix trees over sampled word suffixes.

A window is ``WINDOW`` consecutive words.  A window's anchor is the place, among its k-grams of
``PREFIX`` words, of the least hash; equal windows have their anchors at the same distance, so
the suffixes that start at anchors (one in eight or nine) are enough to find all repeats.

1. *Vertical partitioning.*  The suffixes at anchors are counted by their first ``PREFIX`` words.
   A prefix that occurs once has a leaf only, so its windows are unique and go no further.
   A prefix of at most ``GROUP`` suffixes is a memory-sized group.  One of more is lengthened to
   the whole window.
2. *Subtrees.*  A task reads the suffixes of a group with the words that their windows reach, and
   refines them word by word, to the right of the anchor and to its left: the classes of a depth are the
   nodes of the subtree at that depth.  A class whose two depths sum to the window's length
   is a deep node, a repeat; of its occurrences all but the first are repeated.
3. Windows of lengthened prefixes are nodes of full depth by themselves; their first
   occurrence is an aggregate, so no task holds a hot passage.

Repeated stretches are then joined to the texts by row.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, chunks, discard, give_back, light, settle, short_batches, text_of, with_row_key
from .grams import WordCodes, gram_hashes, mixed

WINDOW = 20
PREFIX = 5
#: Suffixes of a group that one task holds.
GROUP = 10_000
#: Suffixes that a task refines together.
TOGETHER = 20_000
SEED = 42

_CODES = WordCodes()


def _end_task() -> None:
    _CODES.clear()
    give_back()


def anchors(codes: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, end of windows) of the anchors of a text's windows.

    The anchor of a window is its least k-gram, the leftmost of equal ones; windows with the same
    anchor follow each other.
    """
    if len(codes) < window:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    h = gram_hashes(codes, prefix)
    width = window - prefix + 1
    windows = len(codes) - window + 1
    at = np.empty(windows, np.int64)
    for lo in range(0, windows, 1 << 16):
        hi = min(windows, lo + (1 << 16))
        at[lo:hi] = np.lib.stride_tricks.sliding_window_view(h[lo : hi + width - 1], width).argmin(axis=1) + np.arange(lo, hi)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], h[at[first]], first, np.append(first[1:], windows)


def _each_text(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(row of the batch, words, word codes) of each text."""
    for i, t in enumerate(b.column(column)):
        words = t.as_py().split()  # bytes: \x20 and \x09-\x0D only
        yield i, words, _CODES.of(words)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and place of each anchor of the texts (f, i, text)."""
    for b in batches:
        for lo, hi in chunks([len(t.as_buffer()) for t in b.column(2)]):
            part = b.slice(lo, hi - lo)
            found = [anchors(codes)[:2] for _, _, codes in _each_text(part, 2)]
            own = pa.array(np.repeat(np.arange(len(found)), [len(at) for at, _ in found]))
            yield batch_of({
                "h": pa.array(np.concatenate([h for _, h in found]).view(np.int64)), "f": part.column(0).take(own),
                "i": part.column(1).take(own), "at": pa.array(np.concatenate([at for at, _ in found]), pa.int32()),
            })
    _end_task()


_SUFFIX = pa.schema([
    ("h", pa.int64()), ("d", pa.int64()), ("f", pa.int64()), ("i", pa.int64()), ("a", pa.int32()), ("left", pa.int32()), ("words", pa.binary()),
])
_SUFFIX_SQL = "h long, d long, f long, i long, a int, left int, words binary"


def _chosen(codes: np.ndarray, spots: pa.Scalar) -> Iterator[tuple[int, int, int, int]]:
    """(hash, place, first window, end of windows) of the anchors at the places ``spots`` of a text."""
    at, h, first, end = anchors(codes)
    own = np.isin(at, spots.values.to_numpy())
    return zip(h[own].view(np.int64).tolist(), at[own].tolist(), first[own].tolist(), end[own].tolist(), strict=True)


def _joined(words: list[bytes]) -> tuple[bytes, list[int]]:
    """The words joined by single spaces, and where each begins."""
    begin = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    return b" ".join(words), [0, *begin.tolist()]


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes at the anchors ``spots`` of each text (f, i, d, text, spots), with the words that their windows reach."""
    for b in batches:
        spots = b.column(4)
        h, own, first, left, text = [], [], [], [], []
        for i, words, codes in _each_text(b, 3):
            whole, begin = _joined(words)
            for key, at, a, z in _chosen(codes, spots[i]):
                h.append(key)
                own.append(i)
                first.append(a)
                left.append(at - a)
                text.append(whole[begin[a] : begin[z + WINDOW - 1] - 1])
        own = pa.array(own, pa.int64())
        yield batch_of({
            "h": pa.array(h, pa.int64()), "d": b.column(2).take(own), "f": b.column(0).take(own), "i": b.column(1).take(own),
            "a": pa.array(first, pa.int32()), "left": pa.array(left, pa.int32()), "words": pa.array(text, pa.binary()),
        })
    _end_task()


def repeated_windows(group: np.ndarray, left: np.ndarray, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Which windows of each suffix occur in an earlier suffix of its group: a matrix by window.

    Suffixes come in order.  ``left`` words of a text precede the anchor; window ``j`` of a suffix
    starts at word ``j`` of its text.  A node of a group's subtree is known by the hash of its path.
    """
    words = [t.split(b" ") for t in texts]
    total = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.append(_CODES.of(list(itertools.chain.from_iterable(words))), np.uint64(0))
    begin = np.cumsum(total) - total
    nowhere = len(codes) - 1

    def paths(step: int, depth: int, root: np.ndarray) -> list[np.ndarray]:
        """The node of each suffix at the depths 0, 1, ..., going from the anchor to one side."""
        out = [root]
        for t in range(depth):
            place = left + t if step > 0 else left - t - 1
            inside = (place >= 0) & (place < total)
            out.append(mixed(out[-1], codes[np.where(inside, begin + place, nowhere)]))
        return out

    right = paths(1, window, group.view(np.uint64))
    lefts = paths(-1, min(int(left.max(initial=0)), window - 1), np.zeros(len(texts), np.uint64))
    out = np.zeros((len(texts), int((total - window + 1).max(initial=0))), bool)
    for back, before in enumerate(lefts):  # windows that start ``back`` words before the anchor
        j = left - back
        live = np.flatnonzero((j >= 0) & (j <= total - window))
        deep = mixed(right[window - back][live], before[live])
        _, first, which = np.unique(deep, return_index=True, return_inverse=True)
        out[live, j[live]] = first[which] != np.arange(len(live))
    return out


_RANGE = pa.schema([("f", pa.int64()), ("i", pa.int64()), ("a", pa.int32()), ("z", pa.int32())])
_RANGE_SQL = "f long, i long, a int, z int"


def _ranges(table: pa.Table) -> pa.RecordBatch:
    """(f, i, first, end) of the repeated windows of whole groups of suffixes."""
    f, i, a = (table.column(c).to_numpy() for c in ("f", "i", "a"))
    some = table.column("d").is_valid().to_numpy()
    order = np.lexsort((a, i, f, table.column("d").fill_null(0).to_numpy(), some))
    words = table.column("words").take(pa.array(order)).to_pylist()  # of equal windows the first in order stays
    h, left = table.column("h").to_numpy()[order], table.column("left").to_numpy()[order].astype(np.int64)
    again = repeated_windows(h, left, words)
    edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    at = order[row]
    return batch_of({
        "f": pa.array(f[at]), "i": pa.array(i[at]), "a": pa.array(a[at] + start, pa.int32()), "z": pa.array(a[at] + end, pa.int32()),
    })


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by group: refine whole groups, about ``TOGETHER`` suffixes at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < TOGETHER:
            continue
        table = pa.Table.from_batches(held)
        h = table.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
        if cut:
            yield _ranges(table.slice(0, cut))
            table = table.slice(cut)
        held, size = table.to_batches(), table.num_rows
    if size:
        yield _ranges(pa.Table.from_batches(held))
    _end_task()


_NODE_SQL = "x binary, d long, f long, i long, a int, z int"


def _full_depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows at lengthened prefixes: one row per text and window content (``x``), its first place there.

    Later places in the same text are repeated for certain; they come as stretches without ``x``.
    """
    for b in batches:
        rows = []
        for i, words, codes in _each_text(b, 3):
            whole, begin = _joined(words)
            seen = set()
            for _, _, first, end in _chosen(codes, b.column(4)[i]):
                for a in range(first, end):
                    x = xxhash.xxh3_128_digest(whole[begin[a] : begin[a + WINDOW] - 1], SEED)
                    if x not in seen:
                        rows.append((x, i, a, a + 1))
                        seen.add(x)
                    elif rows[-1][0] is None and rows[-1][1] == i and rows[-1][3] == a:
                        rows[-1] = (*rows[-1][:3], a + 1)
                    else:
                        rows.append((None, i, a, a + 1))
        own = pa.array([r[1] for r in rows], pa.int64())
        yield batch_of({
            "x": pa.array([r[0] for r in rows], pa.binary()), "d": b.column(2).take(own), "f": b.column(0).take(own), "i": b.column(1).take(own),
            "a": pa.array([r[2] for r in rows], pa.int32()), "z": pa.array([r[3] for r in rows], pa.int32()),
        })
    _end_task()


def repeated_stretches(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """(f, i, stretches): the repeated windows of each row of ``texts(f, i, d, t)`` that has any, as [first, end).

    A window is repeated if its words also start at a smaller (d, f, i, place); a null d is smallest.
    """
    places = settle(texts.select("f", "i", "t").mapInArrow(_anchor_rows, "h long, f long, i long, at int"), "prefixes")
    # written, so that a hot prefix is split by adaptive execution when it is joined
    counts = settle(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "prefix-counts")
    shared = places.join(counts, "h").groupBy("f", "i").agg(
        F.collect_list(F.when(F.col("n") <= group, F.col("at"))).alias("small"), F.collect_list(F.when(F.col("n") > group, F.col("at"))).alias("large")
    )
    shared = settle(shared, "shared-prefixes")  # at most one entry per anchor of the row's own text
    discard(places, counts)
    chosen = texts.join(light(shared, "small", "large"), ["f", "i"])
    small = chosen.filter(F.size("small") > 0).select("f", "i", "d", "t", "small").mapInArrow(_suffix_rows, _SUFFIX_SQL)
    found = small.repartition("h").sortWithinPartitions("h").mapInArrow(_subtrees, _RANGE_SQL)
    large = chosen.filter(F.size("large") > 0).select("f", "i", "d", "t", "large").mapInArrow(_full_depth, _NODE_SQL)
    large = settle(large, "full-depth")
    nodes = large.filter("x is not null")
    place = F.struct(F.col("d").isNotNull().alias("some"), *[F.col(c) for c in ("d", "f", "i")])
    firsts = nodes.groupBy("x").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("x", "first")
    firsts = settle(firsts, "full-depth-firsts")
    hot = nodes.withColumn("own", place).join(firsts, "x").filter("own <> first").select("f", "i", "a", "z")
    every = found.unionByName(hot).unionByName(large.filter("x is null").select("f", "i", "a", "z"))
    out = settle(every.groupBy("f", "i").agg(F.collect_list(F.struct("a", "z")).alias("stretches")), "stretches")
    discard(shared, large, firsts)
    return out


def cut(words: list[bytes], stretches: list[tuple[int, int]]) -> list[bytes]:
    """The words outside of all windows that start in the stretches [first, end)."""
    depth = np.zeros(len(words) + 1, np.int64)
    for a, z in stretches:
        depth[a] += 1
        depth[z - 1 + WINDOW] -= 1
    return [w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if not d]


def _cut_rows(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, kept = [], [], [], []
            for t, found in zip(b.column(1), b.column(2), strict=True):
                words = t.as_py().split()
                left = cut(words, [(s["a"], s["z"]) for s in found.as_py()]) if found.is_valid else words
                text = b" ".join(left)
                n.append(len(words))
                gone.append(len(words) - len(left))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text if with_text else None)
            yield batch_of({
                "id": b.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary()),
            })
        _end_task()

    return run


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, with_text: bool = True
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept), one row per row of ``docs``, whose ids are integers.

    A word is removed if a window of ``WINDOW`` words that covers it also starts earlier: in a row
    of a smaller id, or in the same row before it; a null id is smallest, and rows that repeat an
    id follow each other in a fixed order.  Windows are judged on the input.  ``kept`` joins what is left by single
    spaces (null unless ``with_text``).  A null text has no words; texts shorter than a window lose nothing; no rows give no rows.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("t"))
    rows = with_row_key(rows, "f", "i")
    texts = rows.select("f", "i", F.col("id").cast("long").alias("d"), "t")
    found = light(repeated_stretches(texts, group), "stretches")
    out = rows.join(found, ["f", "i"], "left").select("id", "t", "stretches")
    out = out.mapInArrow(_cut_rows(with_text), f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string")).withColumnRenamed("id", id_col)
