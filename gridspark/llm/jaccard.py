"""Near-duplicates by Jaccard similarity of word shingles, every link confirmed on the exact sets.

1. One read of the texts gives each row a digest of its shingle set and the keys of its MinHash
   bands.  Rows of equal sets are one class from here on.
2. Classes that share a band are candidates; a pair of exactly ``SIMILAR`` shares one of the
   ``BANDS`` bands with probability 0.9996, a more similar one with a greater.  Each class is
   compared with the first class of the band it shares most of; that settles groups of near copies.
3. In bands that still hold several components, what is open is decided by a prefix filter:
   shingles are ordered by their frequency, and two sets of similarity ``SIMILAR`` must share one
   of the rarest ``n - ceil(SIMILAR * n) + 1`` of each, with enough left after it.  This is exact,
   and passages that many texts share make no pair, because they are frequent.  Groups of
   alike sets come together first, by comparing the sets of a shingle with one of them.

Sets are built where the text is read and shuffled once per comparison; what is written in
between is deleted when its last reader has ended.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, chunks, discard, give_back, light, settle, short_batches, text_of, with_row_key
from .components import components
from .grams import WordCodes, gram_hashes, mixed

SHINGLE = 5
SIMILAR = 0.8
BANDS, BAND_ROWS = 20, 5
SEED = 42
#: Classes that one task compares with the same first class.
SHARE = 1_000

_DRAW = np.random.default_rng(SEED)
_FACTORS = _DRAW.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), np.uint32) | np.uint32(1)
_ADDED = _DRAW.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), np.uint32)
_CODES = WordCodes()


def _end_task() -> None:
    _CODES.clear()
    give_back()

#: Lower-cased ASCII letters; other ASCII characters become blanks, the rest stays.
_LETTERS = bytes(ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)) + bytes(range(128, 256))


def shingle_sets(texts: list[list[bytes]]) -> Iterator[np.ndarray]:
    """Ascending distinct hashes of the shingles of each text's lower-cased words; fewer words than a shingle are one together."""
    codes = _CODES.of(list(itertools.chain.from_iterable(texts)))
    grams = gram_hashes(codes, SHINGLE)
    at = 0
    for words in texts:
        n = len(words)
        if n >= SHINGLE:
            own = np.sort(grams[at : at + n - SHINGLE + 1])
            again = own[1:] == own[:-1]
            yield own[np.append(True, ~again)] if again.any() else own
        else:
            yield gram_hashes(codes[at : at + n], n) if n else np.zeros(1, np.uint64)
        at += n


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set."""
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(values), 2048):
        part = values[None, at : at + 2048] * _FACTORS
        part += _ADDED
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key (a signed long) for each band of the signatures, a row each."""
    rows = least.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for i in range(BAND_ROWS):
        keys = mixed(keys, rows[:, :, i])
    with np.errstate(over="ignore"):
        return mixed(keys * np.uint64(0x9E3779B97F4A7C15), np.uint64(SEED)).view(np.int64)


def letters_key(text: bytes) -> int | None:
    """Names texts that are the same but for case, digits, punctuation and white space; None without letters."""
    others: list[str] = []
    if not text.isascii():
        lowered = text.decode().lower()
        others = [c for c in set(lowered) if c > "\x7f" and not c.isalpha()]
        text = lowered.encode()
    text = text.translate(_LETTERS)
    for c in others:
        text = text.replace(c.encode(), b" ")
    left = b" ".join(text.split())
    return xxhash.xxh64_intdigest(left, SEED) - (1 << 63) if left else None


def _signed(with_letters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, digest, least, letters = [], [], [], []
            texts = [t.as_py() for t in b.column(2)]
            for lo, hi in chunks([len(t) for t in texts]):
                words = [t.lower().split() for t in texts[lo:hi]]  # bytes: A-Z and \x20, \x09-\x0D only
                n += [len(w) for w in words]
                for hashes in shingle_sets(words):
                    digest.append(xxhash.xxh3_128_digest(hashes.tobytes(), SEED))
                    least.append(least_values(hashes))
            letters = [letters_key(t) if with_letters else None for t in texts]
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS)
            flat = pa.array(band_keys(np.stack(least)).ravel())
            yield batch_of({
                "f": b.column(0), "i": b.column(1), "words": pa.array(n, pa.int64()), "x": pa.array(digest, pa.binary()),
                "letters": pa.array(letters, pa.int64()), "bands": pa.ListArray.from_arrays(ends, flat),
            })
        _end_task()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle set of each text; the columns before the text are kept."""
    for b in batches:
        own = b.num_columns - 1
        texts = [t.as_py() for t in b.column(own)]
        sets = []
        for lo, hi in chunks([len(t) for t in texts]):
            sets += [s.tobytes() for s in shingle_sets([t.lower().split() for t in texts[lo:hi]])]
        names = b.schema.names[:own]
        yield batch_of({**{c: b.column(c) for c in names}, "s": pa.array(sets, pa.binary())})
    _end_task()


def similar_sets(a: np.ndarray, b: np.ndarray, similar: float) -> bool:
    if min(len(a), len(b)) < similar * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similar * (len(a) + len(b) - both)


def _compared(similar: float):
    """Links (u, v) from rows (u, part, v, s) by u and part, where the row with a null v is the set of u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for b in batches:
            us, vs = [], []
            for u, part, v, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.frombuffer(s, np.uint64)
                if v is None:
                    key, first = (u, part), own
                elif key == (u, part) and similar_sets(first, own, similar):
                    us.append(u)
                    vs.append(v)
            yield batch_of({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})
        _end_task()

    return run


def _star_links(texts: DataFrame, reps: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """The ``pairs(u, v)`` that are similar; a ``u`` with many ``v`` is dealt to several tasks."""
    sizes = settle(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")), "near-sizes")
    parts = F.ceil(F.col("n") / SHARE).cast("int")
    second = pairs.join(sizes, "u").select(F.col("v").alias("node"), "u", F.pmod(F.xxhash64("v"), parts).cast("int").alias("part"), "v")
    heads = sizes.select(F.col("u").alias("node"), "u", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("long").alias("v"))
    wanted = settle(second.unionByName(heads).join(reps.select("node", "f", "i"), "node").select("f", "i", "u", "part", "v"), "near-wanted")
    rows = texts.join(light(wanted), ["f", "i"]).select("u", "part", "v", "t").mapInArrow(_sets, "u long, part int, v long, s binary")
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    links = settle(rows.mapInArrow(_compared(similar), "u long, v long"), "near-links")
    discard(wanted, sizes)
    return links


_OPEN_SQL = "node long, root long, s array<long>"


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _sets(batches):
        sets = [np.frombuffer(s.as_py(), np.int64) for s in b.column(2)]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate([*sets, np.zeros(0, np.int64)])
        yield batch_of({"node": b.column(0), "root": b.column(1), "s": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})


def prefix_tokens(sets: DataFrame, similar: float) -> DataFrame:
    """(x, node, n, rest): the rare shingles of ``sets(node, s)`` of which similar sets share one, and how many of a set's follow."""
    exploded = sets.select("node", F.explode("s").alias("x"))
    common = exploded.groupBy("x").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # a shingle of one set is rarer than all others: such shingles only move the others back
    ranked = exploded.join(common, "x").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("order"))
    ranked = ranked.join(sets.select("node", F.size("s").alias("n")), "node")
    alone = F.col("n") - F.size("order")
    width = F.greatest(F.col("n") - F.ceil(F.lit(similar) * F.col("n") - F.lit(1e-9)) + 1 - alone, F.lit(0)).cast("int")
    tokens = ranked.select("node", "n", alone.alias("alone"), F.posexplode(F.slice("order", 1, width)).alias("at", "token"))
    return tokens.select(F.col("token.x").alias("x"), "node", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))


def _may_reach(similar: float) -> Column:
    """Are two sets of different roots near enough in size?"""
    alike = F.least("n1", "n2") >= F.lit(similar) * F.greatest("n1", "n2") - F.lit(1e-9)
    return alike & (F.col("root1") != F.col("root2"))


def _side(tokens: DataFrame, k: str) -> DataFrame:
    return tokens.select("x", *[F.col(c).alias(c + k) for c in ("node", "root", "n", "rest")])


def prefix_pairs(tokens: DataFrame, similar: float) -> DataFrame:
    """(u, v): pairs of ``tokens(x, node, root, n, rest)`` of different roots that may reach the similarity; none is left out."""
    # if the first shared shingle is here, at most ``rest`` shingles of either set can be shared
    enough = F.least("rest1", "rest2") >= F.lit(similar / (1 + similar)) * (F.col("n1") + F.col("n2")) - F.lit(1e-9)
    met = _side(tokens, "1").join(_side(tokens, "2"), "x").filter((F.col("node1") < F.col("node2")) & _may_reach(similar) & enough)
    return met.select(F.col("node1").alias("u"), F.col("node2").alias("v")).distinct()


def pivot_pairs(tokens: DataFrame, similar: float, turn: int) -> DataFrame:
    """(u, v): the sets of each shingle with ``PIVOTS`` of them, others every turn; linear in ``tokens``."""
    own = lambda i: F.struct(F.xxhash64("x", "node", F.lit(turn * PIVOTS + i)).alias("draw"), "node", "root", "n", "rest")
    drawn = F.array(*[F.min(own(i)) for i in range(PIVOTS)])
    groups = tokens.groupBy("x").agg(drawn.alias("drawn"), F.min("root").alias("a"), F.max("root").alias("z")).filter("a < z")
    pivots = F.array_distinct(F.transform("drawn", lambda d: F.struct(*[d[c].alias(c + "1") for c in ("node", "root", "n", "rest")])))
    met = settle(groups.select("x", pivots.alias("pivots")), "near-pivots")  # written, so that a hot shingle is split when it is joined
    pairs = met.withColumn("p", F.explode("pivots")).select("x", "p.*").join(_side(tokens, "2"), "x")
    pairs = pairs.filter((F.col("node1") != F.col("node2")) & _may_reach(similar))
    return pairs.select(F.least("node1", "node2").alias("u"), F.greatest("node1", "node2").alias("v")).distinct()


#: Pivots that the sets of a shingle are compared with in a turn.
PIVOTS = 4
#: Turns in which open sets are compared with pivots before all of their pairs are; the first brings nearly all together.
TURNS = 1


def _open_links(texts: DataFrame, reps: DataFrame, bands: DataFrame, roots: DataFrame, similar: float) -> DataFrame | None:
    """Links between classes of different components that share a band; None if no band is open.

    Large groups of alike sets come together by comparing each with a few pivots; what is still
    apart then is compared pair by pair.
    """
    rooted = bands.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a < z").select("key")
    apart = settle(apart, "near-apart")
    nodes = settle(rooted.join(apart, "key").select("node", "root").distinct().join(reps.select("node", "f", "i"), "node"), "near-open")
    discard(apart)
    if nodes.isEmpty():
        discard(nodes)
        return None
    sets = texts.join(light(nodes), ["f", "i"]).select("node", "root", "t").mapInArrow(_arrays, _OPEN_SQL)
    sets = settle(sets, "near-open-sets")
    one, two = (sets.select(F.col("node").alias(k), F.col("s").alias(f"s_{k}")) for k in "uv")
    both = F.size(F.array_intersect("s_u", "s_v"))
    tokens = settle(prefix_tokens(sets, similar).join(nodes.select("node", "root"), "node"), "near-tokens")
    links: list[DataFrame] = []
    for turn in range(TURNS + 1):
        pairs = pivot_pairs(tokens, similar, turn) if turn < TURNS else prefix_pairs(tokens, similar)
        found = pairs.join(one, "u").join(two, "v").filter(both >= F.lit(similar) * (F.size("s_u") + F.size("s_v") - both) - F.lit(1e-9))
        found = settle(found.select("u", "v"), "near-more-links")
        links.append(found)
        if turn == TURNS or found.isEmpty():
            if turn == TURNS:
                break
            continue
        # components of components: roots of the links between roots
        home = tokens.select("node", "root").distinct()
        between = found.join(home.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(
            home.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v"
        )
        merged = components(between.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
        moved = merged.select(F.col("node").alias("root"), F.col("root").alias("to"))
        old, tokens = tokens, settle(tokens.join(moved, "root", "left").select("x", "node", F.coalesce("to", "root").alias("root"), "n", "rest"), "near-tokens")
        discard(old, merged)
    out = settle(reduce(DataFrame.unionByName, links), "near-open-links")
    discard(nodes, sets, tokens, *links)
    return out


def near_rows(docs: DataFrame, id_col: str, text_col: str = "text", similar: float = SIMILAR, letters: bool = False, more: list[str] | None = None) -> DataFrame:
    """(f, i, id, words, root, ...), one row per row of ``docs``: its key, words and component, and the columns ``more``.

    ``docs`` has the row key of :func:`.common.with_row_key` in ``f`` and ``i``.  ``root`` is the
    number of one row of the component, the row's own if it has no near-duplicate.  Texts without
    words (null ones too) are alike.  With ``letters`` texts of the same letters are linked, too.
    """
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select("f", "i", text_of(text_col).cast("binary").alias("t"))
    signed = texts.mapInArrow(_signed(letters), "f long, i long, words long, x binary, letters long, bands array<long>")
    signed = settle(signed.withColumn("node", F.monotonically_increasing_id()), "near-signatures")
    reps = signed.groupBy("x").agg(F.min(F.struct("node", "f", "i")).alias("rep"))
    reps = settle(reps.select("x", "rep.*"), "near-classes")
    bands = signed.join(reps.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("key"))
    # written, so that adaptive execution splits a hot band when it is joined
    shared = bands.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    shared = settle(shared, "near-shared")
    bands = settle(bands.join(shared, "key"), "near-bands")
    firsts = bands.filter("node <> first").groupBy("node", "first").agg(F.count(F.lit(1)).alias("n"))
    pairs = firsts.groupBy("node").agg(F.max(F.struct(F.col("n"), (-F.col("first")).alias("first"))).alias("best"))
    links = [_star_links(texts, reps, pairs.select((-F.col("best.first")).alias("u"), F.col("node").alias("v")), similar)]
    if letters:
        least = signed.filter("letters is not null").join(reps.select("x", F.col("node").alias("rep")), "x").select("letters", "rep")
        heads = least.groupBy("letters").agg(F.min("rep").alias("u"), F.max("rep").alias("z")).filter("u < z").select("letters", "u")
        links.append(settle(least.join(heads, "letters").filter("u <> rep").select("u", F.col("rep").alias("v")).distinct(), "near-letters"))
    known = links[0] if len(links) == 1 else links[0].unionByName(links[1])
    roots = components(known)
    found = _open_links(texts, reps, bands, roots, similar)
    if found is not None:
        links.append(found)
        if not found.isEmpty():
            discard(roots)
            roots = components(known.unionByName(found))
    own = docs.select("f", "i", F.col(id_col).alias("id"), *(more or []))
    classes = reps.select("x", F.col("node").alias("rep")).join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("x", F.coalesce("root", "rep").alias("root"))
    rooted = signed.select("f", "i", "words", "x").join(classes, "x").drop("x")
    out = settle(own.join(rooted, ["f", "i"]), "near-rows")
    discard(signed, reps, shared, bands, roots, *links)
    return out
