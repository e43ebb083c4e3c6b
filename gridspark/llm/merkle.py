"""Merkle manifest of a dataset, built and read back by time-forward processing.

Nodes of a tree are labelled (last leaf below, level); a child's label comes before its parent's.
A task walks its nodes in label order.  Each node sends its digest to its parent through a
priority queue ordered by label, and a parent is computed when its label is next: so the queue
never holds more than one unfinished run per level.  The reversed sweep starts at the root; a
node sends each child the proof suffix that leads from it to the root, again by label, until the
leaves have their proofs.

A tree is cut into blocks of ``FANOUT ** LEVELS`` consecutive nodes of one level.  A sweep climbs
all blocks of a level at once; their tops are the nodes of the next sweep.  What passes from
block to block is written and delivered by Spark's sorted shuffle, the queue's external part.
So no task holds more than one block's queue, however many documents one language has.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..operators.joins import sized_broadcast
from .common import batch_of, fold, fresh, give_back, settle

#: Consecutive nodes that become one parent.
FANOUT = 8
#: Levels that one sweep climbs; a block has ``FANOUT ** LEVELS`` nodes.
LEVELS = 4
#: Rows of a batch that a sweep emits.
_EMIT = 4096


def part_of(column: Column, as_text: bool = False) -> Column:
    """A field of a leaf: ``-`` if null, else its length in UTF-8 bytes, ``:`` and the value."""
    value = column if as_text else column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: list[str], text: Column) -> Column:
    return F.sha2(F.concat(*[part_of(F.col(c)) for c in columns], part_of(text, True)), 256)


def hash_run(kids: list[bytes]) -> bytes:
    """Digest of a run of digests; they are concatenated as hex text."""
    return hashlib.sha256(b"".join(kids).hex().encode()).digest()


class Suffix:
    """Proof from a node up to the root: its place in its run, the run, and the parent's suffix."""

    __slots__ = ("at", "kids", "rest", "text")

    def __init__(self, at: int, kids: list[bytes], rest: Suffix | None):
        self.at, self.kids, self.rest = at, kids, rest
        siblings = b"".join(k for i, k in enumerate(kids) if i != at)
        self.text = siblings.hex() + (rest.text if rest else "")

    def steps(self) -> list[dict]:
        out, here = [], self
        while here:
            out.append({"at": here.at, "kids": b"".join(here.kids)})
            here = here.rest
        return out

    @staticmethod
    def of(steps: list[dict] | None) -> Suffix | None:
        here = None
        for step in reversed(steps or []):
            here = Suffix(step["at"], [step["kids"][i : i + 32] for i in range(0, len(step["kids"]), 32)], here)
        return here


def fold_up(digest: bytes, suffix: Suffix | None) -> bytes:
    """The root that a node's digest leads to with the siblings of its suffix."""
    while suffix:
        digest = hash_run([*suffix.kids[: suffix.at], digest, *suffix.kids[suffix.at + 1 :]])
        suffix = suffix.rest
    return digest


def climb_block(digests: Iterator[tuple[int, bytes]], rise: int, n: int) -> Iterator[tuple[int, int, list[bytes] | None, bytes]]:
    """(level, index, children, digest) of the inner nodes above one block's nodes (index, digest), in label order.

    ``n`` nodes are on the level of the block in the whole tree; ``rise`` levels are climbed.
    """
    queue: list[tuple[int, int, int, int, bytes]] = []  # label (last leaf, level), own index, child, its digest

    def send(level: int, index: int, digest: bytes) -> None:
        parent, width = index // FANOUT, FANOUT ** (level + 1)
        last = min((parent + 1) * width, n) - 1
        heapq.heappush(queue, (last, level + 1, parent, index, digest))

    def due(before: int) -> Iterator[tuple[int, int, list[bytes], bytes]]:
        while queue and queue[0][0] < before:
            last, level, index, _, _ = queue[0]
            kids = []
            while queue and queue[0][:2] == (last, level):
                kids.append(heapq.heappop(queue)[4])
            digest = hash_run(kids)
            if level < rise:
                send(level, index, digest)
            yield level, index, kids, digest

    for index, digest in digests:
        yield from due(index)
        if rise:
            send(0, index, digest)
    yield from due(n)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)
    give_back()


def _emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(itertools.islice(rows, _EMIT)):
        yield batch_of({f.name: pa.array(c, f.type) for f, c in zip(schema, zip(*held, strict=True), strict=True)})


_STEPS = pa.list_(pa.struct([("at", pa.int32()), ("kids", pa.binary())]))
_STEPS_SQL = "array<struct<at: int, kids: binary>>"
#: A node of a sweep (``kids``), or the top of a block (``top``), which is a node of the next sweep.
_UP = pa.schema([
    ("g", pa.string()), ("block", pa.int64()), ("last", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()),
    ("n", pa.int64()), ("height", pa.int32()), ("kids", pa.binary()), ("top", pa.binary()),
])
_UP_SQL = "g string, block long, last long, level int, idx long, n long, height int, kids binary, top binary"


def _climb(levels: int):
    """The upward sweep over rows (g, block, idx, n, height, digest), which come by tree, block and index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (g, block), own in itertools.groupby(_rows(batches), key=lambda r: r[:2]):
                head = next(own)
                n, height = head[3:5]
                rise = min(levels, height)
                if not rise:  # the only node of its tree
                    yield g, block, 0, 0, 0, n, 0, None, head[5]
                    continue
                nodes = ((r[2], r[5]) for r in itertools.chain([head], own))
                above = -(-n // FANOUT**rise)
                for level, index, kids, digest in climb_block(nodes, rise, n):
                    last = min((index + 1) * FANOUT**level, n) - 1
                    yield g, block, last, level, index, n, height, b"".join(kids), None
                    if level == rise:
                        yield g, block, last, level, index, above, height - rise, None, digest

        yield from _emit(rows(), _UP)

    return run


def descend_block(nodes: Iterator[tuple[int, int, int, object]], top: Suffix | None, n: int) -> Iterator[tuple[object, Suffix | None]]:
    """(load, suffix) of each leaf among the nodes (last leaf, level, index, load) of a block, which come in falling label order.

    The load of an inner node is its children's digests; a leaf (level 0) carries anything.
    """
    queue: list[tuple[int, int, int, Suffix | None]] = []  # label negated, index, suffix
    for at, (last, level, index, load) in enumerate(nodes):
        suffix = heapq.heappop(queue)[3] if at else top
        if not level:
            yield load, suffix
            continue
        kids = [load[i : i + 32] for i in range(0, len(load), 32)]
        width = FANOUT ** (level - 1)
        for i in range(len(kids)):
            child = index * FANOUT + i
            heapq.heappush(queue, (1 - min((child + 1) * width, n), 1 - level, child, Suffix(i, kids, suffix)))


_DOWN = pa.schema([("g", pa.string()), ("block", pa.int64()), ("steps", _STEPS), ("subroot", pa.binary())])
_DOWN_SQL = f"g string, block long, steps {_STEPS_SQL}, subroot binary"
#: A message to the top of a block sorts before all of its nodes.
_FIRST = (1 << 63) - 1


def _sweep_down(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(tree, subroot, leaf's load, its suffix) from rows (g, block, last, level, idx, n, kids, steps, subroot, *load)."""
    for (g, _), own in itertools.groupby(rows, key=lambda r: r[:2]):
        message, head = next(own), next(own, None)
        if head is None:
            continue  # no rows at all
        nodes = ((r[2], r[3], r[4], r[6] if r[3] else (r[4], *r[9:])) for r in itertools.chain([head], own))
        for load, suffix in descend_block(nodes, Suffix.of(message[7]), head[5]):
            yield g, message[8], load, suffix


def _pass_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix of each node that the sweep above ends in, which tops a block of the sweep below."""
    found = _sweep_down(_rows(batches))
    yield from _emit(((g, load[0], suffix.steps() if suffix else [], subroot) for g, subroot, load, suffix in found), _DOWN)


def _prove(root: bytes, id_type: pa.DataType):
    schema = pa.schema([
        ("id", id_type), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
        ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("proof", _STEPS),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, subroot, (_, name, digest, tampered), suffix in _sweep_down(_rows(batches)):
                folded = fold_up(tampered, suffix)
                text = suffix.text if suffix else ""
                yield (
                    name, digest.hex(), subroot.hex(), root.hex(), hashlib.sha256(text.encode()).hexdigest(),
                    folded.hex(), folded == root, suffix.steps() if suffix else [],
                )

        yield from _emit(rows(), schema)

    return run


class Trees:
    """The Merkle trees over ``nodes(g, idx, n, digest)``: one for each ``g``, whose ``n`` nodes are numbered from 0."""

    def __init__(self, nodes: DataFrame, name: str, levels: int = LEVELS):
        self.name, self.block, self.sweeps = name, FANOUT**levels, []
        most = nodes.agg(F.max("n")).first()[0] or 0
        height, width, tall = F.lit(0), 1, 0
        while width < most:  # grows with the logarithm of the largest tree
            width, tall = width * FANOUT, tall + 1
            height = F.when(F.col("n") > width // FANOUT, tall).otherwise(height)
        here = nodes.select("g", "idx", "n", height.alias("height"), "digest")
        for _ in range(0, tall, levels):
            dealt = self._dealt(here).select("g", "block", "idx", "n", "height", "digest")
            dealt = dealt.repartition("g", "block").sortWithinPartitions("g", "block", "idx")
            up = settle(dealt.mapInArrow(_climb(levels), _UP_SQL), f"{name}-up")
            self.sweeps.append((here, up.filter("kids is not null").drop("top", "height")))
            here = up.filter("top is not null").select("g", "idx", "n", "height", F.col("top").alias("digest"))
        self.roots = here.select("g", "digest")

    def _dealt(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.expr(f"idx div {self.block}"))

    def down(self, proofs: DataFrame, leaves: DataFrame) -> DataFrame:
        """Rows of the reversed sweep over the leaves, sorted, from ``proofs(g, steps, subroot)`` of the roots.

        ``leaves(g, idx, n, ...)`` may carry further columns.
        """
        messages = proofs.select("g", F.lit(0).cast("long").alias("block"), "steps", "subroot")
        for at in range(len(self.sweeps) - 1, 0, -1):
            base, inner = self.sweeps[at]
            rows = self._stream(messages, inner, base.select("g", "idx", "n"))
            messages = settle(rows.mapInArrow(_pass_down, _DOWN_SQL), f"{self.name}-down")
        return self._stream(messages, self.sweeps[0][1] if self.sweeps else None, leaves)

    def _stream(self, messages: DataFrame, inner: DataFrame | None, leaves: DataFrame) -> DataFrame:
        extra = [c for c in leaves.columns if c not in ("g", "idx", "n")]
        head = ["g", "block", "last", "level", "idx", "n", "kids", "steps", "subroot"]
        own = self._dealt(leaves).withColumns({"last": F.col("idx"), "level": F.lit(0), "kids": F.lit(None).cast("binary")})
        every = own.unionByName(messages.withColumn("last", F.lit(_FIRST)), allowMissingColumns=True)
        if inner is not None:
            every = every.unionByName(inner, allowMissingColumns=True)
        rows = every.select(*head, *extra).repartition("g", "block")
        return rows.sortWithinPartitions("g", "block", F.desc("last"), F.desc("level"))


def number_nodes(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``idx``, the place of each in its ``g`` by ``order``, and ``n``, the number of nodes of ``g``.

    Rows are dealt by ranges of (g, order), so a large ``g`` lies in many partitions; each partition
    numbers its own and adds what precedes it.
    """
    by = ["g", *order]
    mid = fresh(nodes, "_mid")
    ranged = settle(
        nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(mid, F.monotonically_increasing_id()), f"{name}-ranged"
    )
    part = F.shiftright(mid, 33)
    sizes = ranged.groupBy("g", part.alias("_part")).agg(F.count(F.lit(1)).alias("_own"), F.min(mid).alias("_least"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of a g
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0))).withColumn("n", F.sum("_own").over(Window.partitionBy("g")))
    placed = ranged.withColumn("_part", part).join(sized_broadcast(settle(offsets, f"{name}-offsets")), ["g", "_part"])
    return placed.withColumn("idx", F.col(mid) - F.col("_least") + F.col("_before")).drop("_part", "_own", "_least", "_before", mid)


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars"), text_col: str = "text", tampered: Column | None = None, levels: int = LEVELS,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified, proof), one row per row of ``docs``.

    Each ``group_col`` has a tree over its rows by id (nulls first; rows that repeat an id by leaf);
    the trees' roots, by group (null first, then bytewise), are the leaves of the last tree.  Fields
    may be null, texts empty; no rows give no rows.  ``tampered`` is the text as found
    later (by default unchanged): ``folded_root`` is what its leaf leads to with the original
    siblings, and ``verified`` tells whether that is the root.  ``proof`` lists the runs from the leaf to the root.
    """
    text = F.col(text_col).cast("string")
    leaf = lambda t: F.unhex(leaf_digest(list(fields), t))
    group = F.when(F.col(group_col).isNull(), "-").otherwise(F.concat(F.lit(":"), F.col(group_col).cast("string")))
    rows = docs.select(
        group.alias("g"), F.col(id_col).alias("id"), leaf(text).alias("digest"),
        leaf(text if tampered is None else tampered).alias("tampered"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = settle(number_nodes(rows, ["id", "digest", "row"], "leaves").drop("row"), "leaves")
    trees = Trees(leaves.select("g", "idx", "n", "digest"), "tree", levels)
    subroots = trees.roots.select(F.lit("").alias("g"), F.col("g").alias("tree"), "digest")
    subroots = settle(number_nodes(subroots, ["tree"], "subroots"), "subroots")
    forest = Trees(subroots.select("g", "idx", "n", "digest"), "forest", levels)
    top = forest.roots.select("digest").first()
    root = bytes(top[0]) if top else b""
    start = docs.sparkSession.createDataFrame([("", [])], f"g string, steps {_STEPS_SQL}").withColumn("subroot", F.lit(None).cast("binary"))
    rows = forest.down(start, subroots.select("g", "idx", "n", "tree", F.col("digest").alias("own")))
    proofs = settle(rows.mapInArrow(_to_trees, f"g string, steps {_STEPS_SQL}, subroot binary"), "subroot-proofs")
    found = trees.down(proofs, leaves.select("g", "idx", "n", "id", "digest", "tampered"))
    kind = docs.schema[id_col].dataType
    schema = (
        f"id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, "
        f"folded_root string, verified boolean, proof {_STEPS_SQL}"
    )
    return found.mapInArrow(_prove(root, to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)


def _to_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix of each subroot, under the name of its tree."""
    schema = pa.schema([("g", pa.string()), ("steps", _STEPS), ("subroot", pa.binary())])
    found = _sweep_down(_rows(batches))
    yield from _emit(((load[1], suffix.steps() if suffix else [], load[2]) for _, _, load, suffix in found), schema)


def lowered_where(text: Column, condition: Column) -> Column:
    """The text with A-Z lower-cased where the condition holds."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.when(condition, F.translate(text, letters.upper(), letters)).otherwise(text)


def tamper(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Texts of a third of the ids, lower-cased (a null id counts as the empty text)."""
    return lowered_where(F.col(text_col).cast("string"), fold(id_col, 3) == 0)
