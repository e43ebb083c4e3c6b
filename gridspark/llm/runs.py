"""Periodic runs of words: seed-and-extend on the diagonals of a document against itself.

A run of smallest period ``q`` and ``max(LEAST, POWER * q)`` words or more puts at least
``overlap(q)`` equal pairs side by side on the diagonal of lag ``q``.  Periods are taken in
classes; the k-grams of a class are as long as the overlap of its shortest period and no
shorter than its longest.  Then, inside a run, the next occurrence of a k-gram lies exactly one
period ahead (a nearer one would give the run a shorter period), so the pairs of neighbouring
occurrences hold every seed, and their number is linear.  A seed is extended along its
diagonal both ways; a table of the furthest pair covered on each lag suppresses seeds of a
diagonal already walked.  Classes end where no k-gram occurs twice.

Every document is a row of its own and nothing is shuffled: time and memory grow with the longest
document by n log n.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, chunks, give_back, short_batches, text_of

#: A run has at least so many words, and at least so many periods.
LEAST, POWER = 6, 4


def overlap(period: int) -> int:
    """Equal pairs at lag ``period`` that the shortest accepted run of that period has."""
    return max(LEAST, POWER * period) - period


def _classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """(k, first period, last period): classes of periods, each searched with its k-grams."""
    first = 1
    while first <= longest:
        k = min(overlap(q) for q in range(first, first + LEAST))
        yield k, first, min(k, longest)
        first = k + 1


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank of each key, its positions by key, whether each equals the key before it)."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order[1:]] == keys[order[:-1]]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(~same) - 1
    return rank, order, same


def _paired(rank: np.ndarray, length: int, k: int) -> np.ndarray:
    """Keys of the k-grams at all positions that have one, from ranks of ``length``-grams."""
    n = len(rank) - (k - length)
    return rank[:n] * np.int64(len(rank) + 1) + rank[k - length :]


def _seeds(words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, positions, lags) of neighbouring occurrences of a class's k-grams, by lag and position."""
    rank, length = words, 1
    for k, first, last in _classes(longest):
        if k > len(words):
            return
        while 2 * length <= k:
            rank, _, _ = _ranks(_paired(rank, length, 2 * length))
            length *= 2
        grams = rank if length == k else _paired(rank, length, k)
        _, order, same = _ranks(grams)
        if not same.any():
            return  # longer k-grams do not repeat either
        at = order[:-1][same[1:]]
        lag = order[1:][same[1:]] - at
        fit = (lag >= first) & (lag <= last)
        at, lag = at[fit], lag[fit]
        by = np.lexsort((at, lag))
        yield k, at[by], lag[by]


def _reach(words: np.ndarray, a: int, b: int, step: int, room: int) -> int:
    """How many of ``room`` pairs equal each other from (a, b) on, in direction ``step``."""
    done, width = 0, 64
    while done < room:
        width = min(width, room - done)
        if step > 0:
            bad = np.flatnonzero(words[a + done : a + done + width] != words[b + done : b + done + width])
        else:
            one = words[a - done - width + 1 : a - done + 1][::-1]
            bad = np.flatnonzero(one != words[b - done - width + 1 : b - done + 1][::-1])
        if len(bad):
            return done + int(bad[0])
        done, width = done + width, 2 * width
    return done


def find_runs(words: np.ndarray, ends: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start and period.

    ``words`` holds the word numbers of several documents in a row, each of which ends at its
    entry of ``ends``; no two documents may share a number, so no k-gram spans two of them twice.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    longest = int((ends - starts).max(initial=0)) // POWER
    for k, at, lag in _seeds(words, longest):
        # of seeds side by side on a diagonal the first leads; the others are covered by it
        lead = np.ones(len(at), bool)
        lead[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        covered: dict[int, int] = {}
        for i, q in zip(at[lead].tolist(), lag[lead].tolist(), strict=True):
            if i < covered.get(q, -1):
                continue
            doc = int(np.searchsorted(ends, i, side="right"))
            lo, hi = int(starts[doc]), int(ends[doc])
            if i + q >= hi:
                continue
            fore = _reach(words, i, i + q, 1, hi - i - q)
            back = _reach(words, i - 1, i + q - 1, -1, i - lo)
            covered[q] = i + fore
            length = back + fore + q
            if fore + back >= k and length >= max(LEAST, POWER * q):
                out[doc].append((i - back - lo, length, q))
    return [sorted(set(runs)) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if not d]


def number_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts in a row, end of each text); texts share no number."""
    numbers: list[int] = []
    for words in texts:
        seen: dict[bytes, int] = {}
        base = len(numbers)  # numbers below it are taken
        numbers.extend(base + seen.setdefault(w, len(seen)) for w in words)
    return np.array(numbers, np.int64), np.cumsum([len(w) for w in texts]).astype(np.int64)


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The words, made periodic from a place on where 10 divides ``h``; see the query."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_OUT = {
    "runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
    "runs_sha256": pa.string(), "collapsed": pa.binary(), "collapsed_sha256": pa.string(),
}


def _find(plant: bool, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts = b.column(1), b.column(2)
            sizes = [len(t.as_buffer() or b"") for t in texts]
            for lo, hi in chunks(sizes):
                words = [t.as_py().split() for t in texts[lo:hi]]  # bytes: \x20 and \x09-\x0D only
                if plant:
                    words = [planted(w, zlib.crc32(d.as_py().encode())) for w, d in zip(words, names[lo:hi], strict=True)]
                found = find_runs(*number_words(words))
                left = [b" ".join(collapse(w, r)) for w, r in zip(words, found, strict=True)]
                listed = ["".join(f"{s},{n},{q}\n" for s, n, q in r).encode() for r in found]
                yield batch_of({
                    "id": b.column(0).slice(lo, hi - lo),
                    "runs": pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], _OUT["runs"]),
                    "runs_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in listed]),
                    "collapsed": pa.array(left if with_text else [None] * len(left), pa.binary()),
                    "collapsed_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left]),
                })
        give_back()

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, with_text: bool = True
) -> DataFrame:
    """(id, runs, runs_sha256, collapsed, collapsed_sha256), one row per row of ``docs``.

    ``runs`` are (start, length, period) by start and period; ``collapsed`` is the text with one
    period of each run, its words joined by a space (null unless ``with_text``).  Null and empty
    texts have no words, no runs and an empty collapsed text; rows that repeat are treated each
    for itself; no rows give no rows.  ``plant`` makes some texts periodic first, by the crc32
    of the id (a null id counts as the empty text); the digests show that each was found.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), text_of(text_col).cast("binary").alias("t")
    )
    schema = (
        f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, runs_sha256 string, "
        "collapsed binary, collapsed_sha256 string"
    )
    out = rows.mapInArrow(_find(plant, with_text), schema)
    return out.withColumn("collapsed", F.col("collapsed").cast("string")).withColumnRenamed("id", id_col)


def longest_run(runs: str = "runs"):
    """The run of greatest length; of equal ones the smallest start, then the smallest period (null if none)."""
    key = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    return F.array_max(key)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers of runs, the longest one and the digests of :func:`periodic_runs`."""
    rows = found.withColumn("best", longest_run())
    period = -F.col("best.period")
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        period.alias("period"), F.floor(1000 * F.col("best.length") / period).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )
