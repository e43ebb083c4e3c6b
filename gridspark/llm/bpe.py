"""Byte-level BPE over whole texts, without regular expressions.

Pre-tokenisation follows the pattern of the public rank files::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Every code point has a class (letter, number, space, other white space, other), refined by one
look ahead: white space that is the last before a non-space, and an apostrophe that begins a
contraction.  Each refined class is a transition function over eight states.  Composition of
such functions is associative and closed in a small table, so the state before every character
of a whole batch comes from a blocked prefix scan over table look-ups.  Where the scan says so,
a piece begins.  Pieces are sliced and merged by rank, through a cache; their offsets are kept.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, chunks, give_back, short_batches, text_of

#: Pieces that a worker keeps encoded before it starts anew.
CACHE = 400_000

# -- classes and transition functions ---------------------------------------------------------

LETTER, NUMBER, OTHER, SPACE, WHITE, SPACE_LAST, WHITE_LAST, QUOTE1, QUOTE2 = range(9)
# states: what the open piece may still take
(FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, PREFIX, TAKE1, TAKE2) = range(8)
#: Code points of Unicode White_Space.
WHITE_SPACE = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
#: Letters and numbers that Unicode 16 added, which older interpreters do not know.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
]


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, does a piece begin at this character)."""
    if symbol == LETTER:
        if state == TAKE2:
            return TAKE1, False
        if state == TAKE1:
            return FREE, False
        return IN_LETTERS, state not in (IN_LETTERS, PREFIX)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, PREFIX)
    if symbol == OTHER or (symbol in (QUOTE1, QUOTE2) and state in (IN_OTHERS, PREFIX)):
        return IN_OTHERS, state not in (IN_OTHERS, PREFIX)
    if symbol in (QUOTE1, QUOTE2):
        return (TAKE1 if symbol == QUOTE1 else TAKE2), True
    if symbol == SPACE_LAST:
        return PREFIX, True
    if symbol == WHITE_LAST:
        return FREE, True
    return IN_WHITE, state != IN_WHITE


@functools.lru_cache(1)
def _machine():
    """Element of each symbol (row 1: at the start of a text), products, values and starts of pieces."""
    states, symbols = range(8), range(9)
    plain = [tuple(_step(s, c)[0] for s in states) for c in symbols]
    reset = [(f[FREE],) * 8 for f in plain]
    elements = list(dict.fromkeys(plain + reset))
    at = 0
    while at < len(elements):  # close under composition with the generators
        for g in plain + reset:
            h = tuple(g[x] for x in elements[at])
            if h not in elements:
                elements.append(h)
        at += 1
    index = {f: i for i, f in enumerate(elements)}
    product = np.array([[index[tuple(g[x] for x in f)] for g in elements] for f in elements], np.uint8)
    of = np.array([[index[f] for f in plain], [index[f] for f in reset]], np.uint8)
    value = np.array([f[FREE] for f in elements], np.uint8)
    begins = np.array([[_step(s, c)[1] for c in symbols] for s in states])
    return of, product.ravel(), len(elements), value, begins


def _prefix_products(e: np.ndarray, product: np.ndarray, size: int, width: int = 64) -> np.ndarray:
    """Inclusive prefix products of ``e``: blocks in step, then their totals, then both combined."""
    if len(e) <= width:
        out = e.copy()
        for i in range(1, len(e)):
            out[i] = product[int(out[i - 1]) * size + int(e[i])]
        return out
    rows = -(-len(e) // width)
    grid = np.zeros((width, rows), np.uint8)  # column = block, so that a step reads contiguous memory
    full = len(e) // width
    grid[:, :full] = e[: full * width].reshape(full, width).T
    if full < rows:
        grid[: len(e) - full * width, full] = e[full * width :]
    for i in range(1, width):
        grid[i] = product[grid[i - 1].astype(np.intp) * size + grid[i]]
    before = _prefix_products(grid[-1, :-1], product, size, width)
    grid[:, 1:] = product[before.astype(np.intp)[None, :] * size + grid[:, 1:]]
    return grid.T.reshape(-1)[: len(e)]


@functools.lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point, by its general category."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind_, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for lo, hi in ranges:
            table[lo : hi + 1] = kind_
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    return table


def piece_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions where pieces begin in texts laid end to end; ``starts``: where texts begin."""
    if not len(points):
        return np.zeros(0, np.int64)
    of, product, size, value, begins = _machine()
    symbol = class_table()[points]
    first = np.zeros(len(points) + 2, bool)
    first[starts[starts < len(points)]] = True
    first[len(points) :] = True
    ahead = ~first[1:-1]  # is there a next character in the same text
    white = (symbol == SPACE) | (symbol == WHITE)
    last = white & ahead
    last[:-1] &= ~white[1:]
    symbol[last] += SPACE_LAST - SPACE
    quote = np.flatnonzero((points == 0x27) & ahead)
    if len(quote):
        one = points[quote + 1]
        two = np.where(first[quote + 2], 0, points[np.minimum(quote + 2, len(points) - 1)])
        symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        symbol[quote[pair]] = QUOTE2
    state = value[_prefix_products(of[first[: len(points)].view(np.uint8), symbol], product, size)]
    begin = first[: len(points)].copy()
    begin[1:] |= begins[state[:-1], symbol[1:]]
    return np.flatnonzero(begin)


# -- merging ----------------------------------------------------------------------------------


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


_NONE = 1 << 60  # rank of a pair that does not merge


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids: the neighbours of lowest rank merge first, the leftmost of equals before others."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) <= 100:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = ranks.get
        found = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while found and (low := min(found)) != _NONE:
            i = found.index(low)
            parts[i] += parts.pop(i + 1)
            del found[i]
            if i:
                found[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
            if i < len(found):
                found[i] = rank(parts[i] + parts[i + 1], _NONE)
        return [ranks[p] for p in parts]
    # a long piece: a heap of candidate pairs over a linked list
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that begins here; 0: no part begins here
    back = list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heap.append((r, i, end[j])) if not ready else heapq.heappush(heap, (r, i, end[j]))

    ready = False
    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop or not end[j]:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            back[stop] = i
        offer(i)
        if back[i] >= 0:
            offer(back[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]


class Encoder:
    """Encodes batches of texts; one per worker and rank file."""

    def __init__(self, data: bytes):
        self.ranks = read_ranks(data)
        self.cache: dict[str, bytes] = {}

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each text end here, piece offsets in characters, pieces of each text end here)."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        begin = piece_starts(points, edge[:-1])
        bounds = begin.tolist() + [len(points)]
        pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        cache, ranks = self.cache, self.ranks
        if len(cache) > CACHE:
            cache.clear()
        for p in set(pieces).difference(cache):
            cache[p] = np.array(merge(p.encode("utf-8", "surrogatepass"), ranks), np.int32).tobytes()
        coded = [cache[p] for p in pieces]
        ids = np.frombuffer(b"".join(coded), np.int32)
        upto = np.concatenate(([0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) // 4)))
        last = np.searchsorted(begin, edge)  # pieces before each text
        offsets = begin - np.repeat(edge[:-1], np.diff(last))
        return ids, upto[last], offsets, last


_ENCODERS: dict[int, Encoder] = {}


def _worker_encoder(ranks) -> Encoder:
    key = hash(ranks.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks.value)
    return _ENCODERS[key]


def _share(spark: SparkSession, rank_file: str):
    """The rank file as a broadcast: its size is that of a vocabulary, whatever the corpus."""
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, offsets array<int>) of every row; null text encodes as the empty one.

    ``offsets`` are the character positions at which the pieces begin.  Special tokens are
    ordinary text.  A text without characters has no ids.
    """
    ranks = _share(docs.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(ranks)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in chunks([len(t) for t in texts]):
                ids, cut, offsets, last = encoder.batch(texts[lo:hi])
                yield batch_of({
                    "id": b.column(0).slice(lo, hi - lo),
                    "ids": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids)),
                    "offsets": pa.ListArray.from_arrays(pa.array(last.astype(np.int32)), pa.array(offsets.astype(np.int32))),
                })
        give_back()

    short_batches(docs.sparkSession)

    out = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return out.mapInArrow(run, "id long, ids array<int>, offsets array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, rank_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in ``out_col``; null ids decode to no bytes.

    Unknown ids raise.
    """
    ranks = _share(encoded.sparkSession, rank_file)
    state: dict[str, tuple] = {}

    @F.pandas_udf("binary")
    def join(column):
        if not state:
            tokens = sorted(_worker_encoder(ranks).ranks.items(), key=lambda x: x[1])
            if [r for _, r in tokens] != list(range(len(tokens))):
                raise ValueError("ranks must be dense")
            state["of"] = np.array([t for t, _ in tokens], dtype=object)
        table = state["of"]
        return column.map(lambda ids: b"".join(table[ids]) if ids is not None and len(ids) else b"")

    return encoded.withColumn(out_col, join(F.col(ids_col)))
