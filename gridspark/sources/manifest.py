"""Chunk-reference manifests: parsing, key resolution, decoding and writing."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ieee import NAN
from ..model import GridError
from ..operators.joins import cut_lineage, lookup_join, null_safe_join
from ..operators.msgindex import reconcile
from ..operators.ordered import number_rows, with_neighbours
from .text import read_documents, write_documents

#: Entries per manifest document that :func:`manifest_documents` writes.
SHARD_ENTRIES = 10_000

# Keys of array headers and attributes.
_SPECIAL = r"^(?:.*/)?(\.zarray|\.zattrs|\.zgroup|zarr\.json)$"


def read_manifest(spark: SparkSession, pattern: str, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Array headers and chunk references of all manifest files that match, or of packed ones."""
    if packed:
        return open_manifests(read_documents(spark, pattern).withColumnRenamed("name", "manifest"))
    # the shards of one object are one manifest
    name = F.regexp_replace(F.col("_metadata.file_path"), r"/shard=\d+/[^/]*$", "")
    docs = spark.read.text(pattern, wholetext=True).select(name.alias("manifest"), F.col("value").alias("text"))
    return open_manifests(docs)


def open_manifests(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Array headers and chunk references of manifest documents.

    Only headers are settled; documents are parsed again for their references, so inline
    chunks are not copied.  ``docs`` is best a table of files.
    """
    refs = manifest_refs(docs)
    return cut_lineage(array_meta(refs)), chunk_refs(refs)


def manifest_refs(docs: DataFrame) -> DataFrame:
    """Entries of manifest documents (``manifest``, ``text``): manifest, key, value.

    The references are under ``refs``, else ``virtual_chunks``, else either of them under
    ``manifest``.  ``value`` is JSON text for arrays and objects, plain text for strings.
    """
    inner = "refs MAP<STRING, STRING>, virtual_chunks MAP<STRING, STRING>"
    doc = F.from_json("text", f"STRUCT<{inner}, manifest: STRUCT<{inner}>>")
    return docs.select("manifest", doc.alias("_d")).select(
        "manifest",
        F.explode(F.coalesce("_d.refs", "_d.virtual_chunks", "_d.manifest.refs", "_d.manifest.virtual_chunks")).alias("key", "value"),
    )


def _ints(text: Column) -> Column:
    return F.from_json(text, "ARRAY<INT>")


def array_meta(refs: DataFrame) -> DataFrame:
    """Headers of the arrays (v2 ``.zarray`` with ``.zattrs``, v3 ``zarr.json``).

    Result: manifest, variable, dims, shape, chunks, dtype, fill, units, long_name,
    standard_name, scale_factor, add_offset, is_message.
    """
    # The keys of an array's header and of its attributes.
    kind = F.regexp_extract("key", r"^(?:.*/)?(\.zarray|\.zattrs|zarr\.json)$", 1)
    name = F.regexp_extract("key", r"^(?:(.*)/)?(?:\.zarray|\.zattrs|zarr\.json)$", 1)
    special = refs.withColumn("_kind", kind).filter("_kind <> ''").withColumn("variable", name)
    pick = lambda k: F.max(F.when(F.col("_kind") == k, F.col("value")))
    both = special.groupBy("manifest", "variable").agg(F.coalesce(pick(".zarray"), pick("zarr.json")).alias("h"), pick(".zattrs").alias("_a"))
    both = both.filter("h IS NOT NULL").withColumn("a", F.coalesce("_a", F.get_json_object("h", "$.attributes")))

    # each text is parsed once, not once per field
    head = ["shape", "dimension_names", "chunks", "chunk_grid", "filters", "dtype", "data_type", "fill_value"]
    notes = [
        "_ARRAY_DIMENSIONS", "units", "long_name", "grib2_description", "description", "standard_name", "scale_factor", "add_offset",
        "grib2_discipline",
    ]
    both = both.select("manifest", "variable", "a", F.json_tuple("h", *head).alias(*[f"_h_{n}" for n in head]))
    both = both.select("*", F.json_tuple("a", *notes).alias(*[f"_a_{n}" for n in notes])).drop("a")
    h, a = (lambda name: F.col(f"_h_{name}")), (lambda name: F.col(f"_a_{name}"))
    fill_text = h("fill_value")
    fill = F.when(fill_text == "true", 1.0).when(fill_text == "false", 0.0).otherwise(fill_text.try_cast("double"))
    shape = F.coalesce(_ints(h("shape")), F.array().cast("array<int>"))
    named = F.coalesce(
        F.from_json(a("_ARRAY_DIMENSIONS"), "ARRAY<STRING>"), F.from_json(h("dimension_names"), "ARRAY<STRING>"),
        F.transform(shape, lambda _, i: F.concat(F.lit("dim_"), i.cast("string"))),
    )
    chunks = F.coalesce(
        _ints(h("chunks")), _ints(F.get_json_object(h("chunk_grid"), "$.configuration.chunk_shape")), F.array().cast("array<int>")
    )
    filters = F.from_json(h("filters"), "ARRAY<STRUCT<id: STRING>>")
    message = F.coalesce(F.exists(filters, lambda f: f["id"].isin("grib", "grib2")), F.lit(False)) | a("grib2_discipline").isNotNull()
    return both.select(
        "manifest", "variable", named.alias("dims"), shape.alias("shape"),
        F.when(F.size(chunks) > 0, chunks).otherwise(shape).alias("chunks"),
        F.coalesce(h("dtype"), h("data_type"), F.lit("<f4")).alias("dtype"), fill.alias("fill"),
        a("units").alias("units"),
        F.coalesce(a("long_name"), a("grib2_description"), a("description")).alias("long_name"),
        a("standard_name").alias("standard_name"), a("scale_factor").try_cast("double").alias("scale_factor"),
        a("add_offset").try_cast("double").alias("add_offset"), message.alias("is_message"),
    )


def chunk_refs(refs: DataFrame) -> DataFrame:
    """Chunk references: manifest, key, uri, offset, length, inline.

    Forms: ``[uri, offset, length]``, ``{path|url, offset, length}``, ``base64:…`` and
    plain text.  Malformed entries are left out.
    """
    rows = refs.filter(~F.col("key").rlike(_SPECIAL))
    text = F.ltrim("value")
    triple = F.when(text.startswith("["), F.from_json("value", "ARRAY<STRING>"))
    obj = F.when(text.startswith("{"), F.from_json("value", "STRUCT<path: STRING, url: STRING, offset: BIGINT, length: BIGINT>"))
    body = F.when(text.startswith("[") | text.startswith("{"), F.lit(None).cast("string")).otherwise(F.col("value"))
    inline = F.when(
        body.startswith("base64:"), F.try_to_binary(F.substr(body, F.lit(8)), F.lit("base64"))
    ).otherwise(F.to_binary(body, F.lit("utf-8")))
    out = rows.select(
        "manifest", "key",
        F.coalesce(F.get(triple, F.lit(0)), obj["path"], obj["url"]).alias("uri"),
        F.coalesce(F.get(triple, F.lit(1)).try_cast("bigint"), obj["offset"]).alias("offset"),
        F.coalesce(F.get(triple, F.lit(2)).try_cast("bigint"), obj["length"]).alias("length"),
        inline.alias("inline"),
    )
    return out.filter(
        F.col("inline").isNotNull()
        | (F.col("uri").isNotNull() & (F.col("offset") >= 0) & (F.col("length") >= 0))
    )


def chunk_index(refs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Attach array and chunk indices to chunk references, one per chunk.

    Key forms by precedence: ``v/1.2``, ``v/1/2``, ``v/1_2``, ``v/0`` (first chunk only),
    ``v/c/1/2``, and without a name ``c/1/2``, ``1.2``, ``1/2``.  Several references to
    a chunk are settled by an aggregation, not by ranking.
    """
    names = arrays.select("manifest", "variable", F.size("shape").alias("_rank"))
    # a key can belong to several arrays only by nesting, so offer each prefix
    key = F.col("key")
    parts = F.split(key, "/")
    depth = F.size(parts)
    offers = F.transform(
        F.sequence(F.lit(0), depth - 1),
        lambda n: F.struct(
            F.array_join(F.slice(parts, F.lit(1), n), "/").alias("variable"),
            F.array_join(F.slice(parts, n + 1, depth - n), "/").alias("tail"),
        ),
    )
    rows = refs.withColumn("_o", F.explode(offers)).select(*refs.columns, "_o.variable", "_o.tail")
    rows = lookup_join(rows, names, ["manifest", "variable"], "inner")
    tail, rank = F.col("tail"), F.col("_rank")
    number = r"[0-9]{1,9}"

    def shaped(sep: str, prefix: str = "") -> Column:
        body = F.substr(tail, F.lit(len(prefix) + 1)) if prefix else tail
        fits = body.rlike(f"^{number}({sep}{number})*$") & (tail.startswith(prefix) if prefix else F.lit(True))
        idx = F.transform(F.split(body, sep), lambda x: x.try_cast("int"))
        return F.when(fits & (F.size(F.split(body, sep)) == rank), idx)

    forms = [shaped(r"\."), shaped("/"), shaped("_")]
    zeros = F.when(tail == "0", F.array_repeat(F.lit(0), rank))
    forms += [zeros, shaped("/", "c/")]
    # an array without a name prefers the ``c/`` form
    order = [F.lit(i) for i in range(4)] + [F.when(F.col("variable") == "", -1).otherwise(4)]
    choice = F.coalesce(*[F.when(f.isNotNull(), F.struct(o.alias("p"), f.alias("idx"))) for o, f in zip(order, forms)])
    found = rows.withColumn("_c", choice).filter("_c IS NOT NULL")
    best = found.groupBy("manifest", "variable", F.col("_c.idx").alias("idx")).agg(
        F.min_by(F.struct("uri", "offset", "length", "inline"), F.struct(F.col("_c.p"), F.col("key"))).alias("_b")
    )
    return best.select("manifest", "variable", "idx", "_b.uri", "_b.offset", "_b.length", "_b.inline")


def prune_chunks(chunks: DataFrame, arrays: DataFrame, window: dict[int, tuple[int, int]]) -> DataFrame:
    """Keep the chunks that touch a window: axis number to (first, last) index."""
    rows = lookup_join(chunks, arrays.select("manifest", "variable", F.col("chunks").alias("_size")), ["manifest", "variable"], "inner")
    for axis, (first, last) in window.items():
        size = F.greatest(F.get("_size", F.lit(axis)), F.lit(1))
        at = F.get("idx", F.lit(axis))
        rows = rows.filter((at >= F.floor(F.lit(first) / size)) & (at <= F.floor(F.lit(last) / size)))
    return rows.drop("_size")


# --- decoding (runs inside tasks) ---------------------------------------------------

# Names of element types without a byte order.
_DTYPES = {
    "bool": "?", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4",
    "int64": "i8", "uint64": "u8", "float16": "f2", "float32": "f4", "float64": "f8",
}
# Element types that can be decoded.
_KINDS = {"b1", "i1", "u1", "i2", "u2", "i4", "u4", "i8", "u8", "f2", "f4", "f8"}


def element_type(text: str) -> np.dtype:
    """Exact element type; signed and unsigned are kept apart."""
    t = text.strip()
    if t in _DTYPES:
        return np.dtype(_DTYPES[t]).newbyteorder("<")
    if t[1:] in _KINDS and t[0] in "<>|=":
        return np.dtype(t)
    if t in _KINDS:
        return np.dtype(t).newbyteorder("<")
    raise GridError(f"unsupported array data type '{text}'")


def inflate(data: bytes) -> bytes:
    """Undo gzip or zlib as told by the first bytes; anything else is plain."""
    try:
        if data[:2] == b"\x1f\x8b":
            return gzip.decompress(data)
        if data[:1] == b"\x78" and data[1:2] in (b"\x01", b"\x9c", b"\xda"):
            return zlib.decompress(data)
    except (OSError, EOFError, zlib.error):
        pass
    return data


def _chunk_cells(data: bytes, dtype: str, idx, shape, chunks) -> tuple[np.ndarray, np.ndarray]:
    """Global indices (rank x n) and values of the cells of one chunk inside the array."""
    kind = element_type(dtype)
    raw = inflate(data)
    values = np.frombuffer(raw, dtype=kind, count=len(raw) // kind.itemsize).astype("float64")
    return _placed(values[: int(np.prod(chunks))], idx, shape, chunks)


def _placed(values, idx, shape, chunks):
    """Indices and values of a chunk's cells that lie inside the array."""
    where = np.array(np.unravel_index(np.arange(len(values)), tuple(chunks)), dtype="int64").reshape(len(chunks), -1)
    where += (np.asarray(idx, dtype="int64") * np.asarray(chunks, dtype="int64"))[:, None]
    inside = (where < np.asarray(shape, dtype="int64")[:, None]).all(axis=0)
    return where[:, inside], values[inside]


def _reader(base: str | None):
    """Byte-range reader for local and object-store URIs, one open file at a time."""
    from pyarrow import fs

    state: dict = {}

    def read(uri: str, offset: int, length: int) -> bytes:
        if state.get("uri") != uri:
            if "file" in state:
                state["file"].close()
            if base is None and not ("://" in uri or uri.startswith(("/", "file:"))):
                raise GridError(f"relative reference {uri} needs a base folder")
            full = uri if "://" in uri or uri.startswith(("/", "file:")) else f"{base}/{uri}"
            full = full.replace("file:///", "/").replace("file:/", "/")
            if full.startswith("/"):
                system, path = fs.LocalFileSystem(), full
            else:
                system, path = fs.FileSystem.from_uri(full)
            state["file"], state["uri"] = system.open_input_file(path), uri
        state["file"].seek(offset)
        return state["file"].read(length)

    return read


_DECODED = "manifest STRING, variable STRING, t INT, z INT, r INT, c INT, extra MAP<STRING, INT>, raw DOUBLE"
_BATCH_CELLS = 200_000


def _runs_of(rows: list[dict], fetch, fill_missing: bool) -> Iterator[tuple[list[dict], list[bytes | None]]]:
    """The data of chunks, in pieces of about ``_BATCH_CELLS`` cells; None for a chunk whose object is gone."""
    kept, data, cells = [], [], 0
    for row in rows:
        try:
            found = row["inline"] if row["inline"] is not None else fetch(row["uri"], int(row["offset"]), int(row["length"]))
        except FileNotFoundError:
            if not fill_missing:
                continue
            found = None
        kept.append(row)
        data.append(found)
        cells += int(np.prod(row["chunks"]))
        if cells >= _BATCH_CELLS:
            yield kept, data
            kept, data, cells = [], [], 0
    if kept:
        yield kept, data


def _decoded(rows: list[dict], data: list[bytes | None]) -> Iterator[pa.RecordBatch]:
    """Cells of chunks, those of one form decoded together."""
    forms: dict[tuple, list[tuple[dict, bytes | None]]] = {}
    for row, raw in zip(rows, data, strict=True):
        chunks = tuple(row["chunks"])
        size = int(np.prod(chunks))
        raw = None if raw is None else inflate(raw)
        n = size if raw is None else min(len(raw) // element_type(row["dtype"]).itemsize, size)
        forms.setdefault((row["dtype"], tuple(row["shape"]), chunks, tuple(row["dims"]), n, raw is None), []).append((row, raw))
    for (dtype, shape, chunks, dims, n, gone), found in forms.items():
        kind, rank = element_type(dtype), len(chunks)
        if gone:
            fills = np.array([np.nan if row["fill"] is None else row["fill"] for row, _ in found], dtype="float64")
            values = np.repeat(fills, n)
        else:
            width = n * kind.itemsize
            values = np.frombuffer(b"".join(raw[:width] for _, raw in found), dtype=kind).astype("float64")
        first = np.array([row["idx"] for row, _ in found], dtype="int64").reshape(len(found), rank) * np.array(chunks, dtype="int64")
        inner = np.unravel_index(np.arange(n), chunks) if rank else ()
        where = [(first[:, axis, None] + inner[axis][None, :]).ravel() for axis in range(rank)]
        own = np.repeat(np.arange(len(found)), n)
        if (first + np.array(chunks, dtype="int64") > np.array(shape, dtype="int64")).any():
            inside = np.logical_and.reduce([at < end for at, end in zip(where, shape, strict=True)])
            where, values, own = [at[inside] for at in where], values[inside], own[inside]
        yield _cell_batch([row for row, _ in found], own, where, values, dims)


def _cell_batch(rows: list[dict], own: np.ndarray, where: list[np.ndarray], values: np.ndarray, dims: tuple[str, ...]) -> pa.RecordBatch:
    """Cells of the chunks ``rows[own]`` of one rank; an axis that an array lacks is 0."""
    rank, cells, zero = len(where), len(values), np.zeros(len(values), dtype="int32")
    axis = lambda least, at: pa.array(where[at].astype("int32") if rank >= least else zero)
    if rank > 4:
        more = dims[2:rank - 2]
        if len(more) != rank - 4:
            raise GridError(f"array '{rows[0]['variable']}' of rank {rank} has {len(dims)} dimension names")
        keys = pa.array(more, pa.string()).take(pa.array(np.tile(np.arange(rank - 4), cells)))
        items = pa.array(np.stack(where[2:-2], axis=1).astype("int32").ravel())
        extra = pa.MapArray.from_arrays(pa.array(np.arange(cells + 1, dtype="int32") * (rank - 4)), keys, items)
    else:
        extra = pa.nulls(cells, pa.map_(pa.string(), pa.int32()))
    named = lambda key: pa.array([row[key] for row in rows], pa.string()).take(pa.array(own))
    return pa.RecordBatch.from_arrays(
        [named("manifest"), named("variable"), axis(3, 0), axis(4, 1), axis(2, -2), axis(1, -1), extra, pa.array(values)],
        names=["manifest", "variable", "t", "z", "r", "c", "extra", "raw"],
    )


def decode_chunks(chunks: DataFrame, arrays: DataFrame, base: str | None = None, fill_missing: bool = False) -> DataFrame:
    """Cells of the referenced chunks: manifest, variable, t, z, r, c, extra, raw.

    The last two axes are r and c; of the others the first is t, the second z, and any
    further ones go to the map ``extra``.  References to objects are spread by (uri, offset), so a
    huge object is read by many tasks and each task reads forward; inline chunks are decoded where they are.  A chunk that cannot be
    read fails its task, which Spark repeats.  One whose object does not exist is absent: it
    is left out, or has the fill value with ``fill_missing``.
    Relative URIs need ``base``, a folder that every executor sees.
    """
    head = arrays.select("manifest", "variable", "shape", "chunks", "dtype", "fill", "dims")
    rows = lookup_join(chunks, head, ["manifest", "variable"], "inner")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read_ = rows.filter("inline IS NULL").repartitionByRange(parts, "uri", "offset", "idx").sortWithinPartitions("uri", "offset")
    rows = rows.filter("inline IS NOT NULL").unionByName(read_)
    wanted = rows.select("manifest", "variable", "idx", "uri", "offset", "length", "inline", "shape", "chunks", "dtype", "fill", "dims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(base)
        for batch in batches:
            for kept, data in _runs_of(batch.to_pylist(), read, fill_missing):
                yield from _decoded(kept, data)

    return wanted.mapInArrow(run, _DECODED)


#: Absent chunks of one gap that a row stands for before they are expanded.
GAP_PIECE = 10_000


def absent_runs(chunks: DataFrame, arrays: DataFrame) -> DataFrame:
    """Runs of consecutive chunks without a reference, in C order: manifest, variable, counts, first, n.

    ``chunks``: the result of :func:`chunk_index`, unpruned.  The chunks an array has are numbered
    in C order; what lies between neighbouring numbers is a run.  Nothing is made for each chunk, so
    the work grows with the references, not with the index space.  An array without dimensions has one chunk.
    """
    counts = F.zip_with("shape", "chunks", lambda n, c: F.ceil(n / c))
    total = F.aggregate(counts, F.lit(1).cast("bigint"), lambda acc, n: acc * n)
    space = arrays.select("manifest", "variable", counts.alias("counts"), total.alias("_total")).filter("_total > 0")
    have = lookup_join(chunks.select("manifest", "variable", "idx"), space, ["manifest", "variable"], "inner")
    inside = F.forall(F.zip_with("idx", "counts", lambda i, n: (i >= 0) & (i < n)), lambda ok: ok)
    number = F.aggregate(
        F.zip_with("idx", "counts", lambda i, n: F.struct(i.cast("bigint").alias("i"), n.cast("bigint").alias("n"))),
        F.lit(0).cast("bigint"), lambda acc, x: acc * x["n"] + x["i"],
    )
    numbers = have.filter(inside).select("manifest", "variable", number.alias("_k")).distinct()
    ends = numbers.unionByName(space.select("manifest", "variable", F.col("_total").alias("_k")))
    gaps = with_neighbours(ends, ["manifest", "variable"], [F.col("_k")], {"_k": "_before"})
    first = F.coalesce(F.col("_before"), F.lit(-1)) + 1
    runs = gaps.select("manifest", "variable", first.alias("first"), (F.col("_k") - first).alias("n")).filter("n > 0")
    return lookup_join(runs, space.drop("_total"), ["manifest", "variable"], "inner").select("manifest", "variable", "counts", "first", "n")


def absent_chunks(chunks: DataFrame, arrays: DataFrame) -> DataFrame:
    """The chunks of :func:`absent_runs`, one row each: manifest, variable, idx."""
    runs = absent_runs(chunks, arrays)
    # long runs are cut first, so that no row holds more than a piece of one
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(GAP_PIECE).cast("bigint")))
    pieces = runs.withColumn("_o", start).withColumn("_m", F.least(F.lit(GAP_PIECE), F.col("n") - F.col("_o"))).repartition("manifest", "variable", "first", "_o")
    every = pieces.withColumn("_k", F.explode(F.sequence(F.col("first") + F.col("_o"), F.col("first") + F.col("_o") + F.col("_m") - 1)))
    return every.select("manifest", "variable", _unravel(F.col("_k"), F.col("counts")).alias("idx"))


def _unravel(k: Column, counts: Column) -> Column:
    """Index along each axis of the ``k``-th element in C order."""
    stride = lambda i: F.aggregate(
        F.slice(counts, i + 2, F.greatest(F.size(counts) - i - 1, F.lit(0))), F.lit(1).cast("bigint"), lambda acc, n: acc * n
    )
    return F.transform(counts, lambda n, i: (F.floor(k / stride(i)) % n).cast("int"))


def complete_grid(cells: DataFrame, arrays: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the cells of chunks without a reference, with the fill value, NaN when there is none.

    ``cells`` come from :func:`decode_chunks`, with ``fill_missing`` where objects may be gone.
    Absence is settled between chunk references, so decoded cells are not shuffled; only
    absent chunks are expanded, whatever the number of dimensions.
    """
    head = arrays.select("manifest", "variable", "shape", F.col("chunks").alias("_size"), "dims", "fill")
    gone = lookup_join(absent_chunks(chunks, arrays), head, ["manifest", "variable"], "inner").repartition("manifest", "variable", "idx")
    inside = F.aggregate("_size", F.lit(1).cast("bigint"), lambda acc, n: acc * n)
    rows = gone.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), inside - 1)))
    offset = _unravel(F.col("_k"), F.transform("_size", lambda n: n.cast("bigint")))
    start = F.zip_with("idx", "_size", lambda i, n: i * n)
    rows = rows.withColumn("_at", F.zip_with(start, offset, lambda a, b: (a + b).cast("int")))
    rows = rows.filter(F.forall(F.zip_with("_at", "shape", lambda i, n: i < n), lambda ok: ok))
    rank = F.size("_at")

    def axis(test: Column, at: Column) -> Column:
        return F.when(test, F.get("_at", at)).otherwise(F.lit(0)).cast("int")

    extra = F.when(rank > 4, F.map_from_arrays(F.slice("dims", F.lit(3), F.greatest(rank - 4, F.lit(0))), F.slice("_at", F.lit(3), F.greatest(rank - 4, F.lit(0)))))
    filled = rows.select(
        "manifest", "variable", axis(rank >= 3, F.lit(0)).alias("t"), axis(rank >= 4, F.lit(1)).alias("z"),
        axis(rank >= 2, rank - 2).alias("r"), axis(rank >= 1, rank - 1).alias("c"), extra.alias("extra"),
        F.coalesce("fill", F.lit(NAN)).alias("raw"),
    )
    return cells.select("manifest", "variable", "t", "z", "r", "c", "extra", "raw").unionByName(filled)


# --- writing ------------------------------------------------------------------------


def build_manifest(idx: DataFrame, headers: DataFrame, uri: Column | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Manifest entries of indexed messages and the diagnostics of the rest.

    ``idx``: records of ``parse_idx``; ``headers``: object, offset, seq, message_length,
    description, discipline, grid_template, product_template, category, number, payload.
    Entries: object, key, value (JSON text).  In strict mode any diagnostic is an error.
    """
    matched, diagnostics = reconcile(idx, headers)
    if strict:
        bad = diagnostics.orderBy("object", "line").first()
        if bad is not None:
            raise GridError(f"{bad['object']}: {bad['message']}")
    key = F.when(
        F.col("submessage") == 0, F.format_string("grib2_message_%04d", F.col("ordinal"))
    ).otherwise(F.format_string("grib2_message_%04d_submessage_%04d", F.col("ordinal"), F.col("submessage")))
    where = F.col("object").cast("string") if uri is None else uri
    keep = {"ignoreNullFields": "false"}
    header = F.to_json(F.struct(
        F.lit(2).alias("zarr_format"), F.array(F.lit(1)).alias("shape"), F.array(F.lit(1)).alias("chunks"),
        F.lit("<f4").alias("dtype"), F.lit(None).cast("string").alias("compressor"),
        F.array(F.struct(F.lit("grib").alias("id"), F.col("_key").alias("var"))).alias("filters"),
        F.lit("C").alias("order"), F.lit(None).cast("double").alias("fill_value"),
    ), keep)
    notes = F.to_json(F.struct(
        F.array(F.lit("grib2_message")).alias("_ARRAY_DIMENSIONS"), F.col("line").alias("source_index_line"),
        F.col("offset").alias("source_offset"), F.col("length").alias("source_length"),
        F.col("submessage").alias("grib2_submessage"), F.col("description").alias("grib2_description"),
        F.col("discipline").alias("grib2_discipline"), F.col("grid_template").alias("grib2_grid_template"),
        F.col("product_template").alias("grib2_product_template"),
        F.col("category").alias("grib2_parameter_category"), F.col("number").alias("grib2_parameter_number"),
        F.lower(F.hex("payload")).alias("grib2_product_definition_hex"),
    ), keep)
    ref = F.concat(
        F.lit("["), F.to_json(F.struct(where.alias("u"))).substr(F.lit(6), F.length(F.to_json(F.struct(where.alias("u")))) - 6),
        F.lit(","), F.col("offset").cast("string"), F.lit(","), F.col("length").cast("string"), F.lit("]"),
    )
    rows = matched.withColumn("_key", key)
    entries = rows.select(
        "object",
        F.explode(F.array(
            F.struct(F.concat("_key", F.lit("/.zarray")).alias("key"), header.alias("value")),
            F.struct(F.concat("_key", F.lit("/.zattrs")).alias("key"), notes.alias("value")),
            F.struct(F.concat("_key", F.lit("/0")).alias("key"), ref.alias("value")),
        )).alias("_e"),
    ).select("object", "_e.key", "_e.value")
    return entries, diagnostics


def manifest_documents(entries: DataFrame, diagnostics: DataFrame, shard_entries: int | None = None) -> DataFrame:
    """Manifest documents of about ``shard_entries`` entries: object, shard, text.

    Arrays are numbered and dealt whole, so a header, its attributes and its chunk share a
    shard.  Shard 0 also has the group header; diagnostics are listed in the attributes of shards
    of their own numbering, in pieces of the same size, so an object with millions of
    messages is written by many tasks.  All shards of an object read as one manifest.
    """
    shard_entries = shard_entries or SHARD_ENTRIES
    named = entries.withColumn("_array", F.regexp_replace("key", "/[^/]*$", ""))
    arrays = number_rows(named.select("object", "_array").distinct(), ["object"], [F.col("_array")], "_n").withColumn(
        "shard", F.floor((F.col("_n") - 1) / max(1, shard_entries // 3)).cast("int")
    )
    numbered = null_safe_join(named, arrays, ["object", "_array"])
    noted = number_rows(diagnostics, ["object"], [F.col("line")], "_n").withColumn(
        "shard", F.floor((F.col("_n") - 1) / shard_entries).cast("int")
    ).groupBy("object", "shard").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line", "message"))), lambda x: x["message"]).alias("_notes")
    )
    quoted = F.to_json(F.struct(F.col("key").alias("k")))
    pair = F.concat(F.substr(quoted, F.lit(6), F.length(quoted) - 6), F.lit(":"), F.col("value"))
    bodies = numbered.groupBy("object", "shard").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("key", pair.alias("p")))), lambda x: x["p"]).alias("_pairs")
    )
    # also an object or a shard that has diagnostics only
    parts = bodies.select("object", "shard").union(noted.select("object", "shard")).distinct()
    both = null_safe_join(null_safe_join(parts, bodies, ["object", "shard"], "left"), noted, ["object", "shard"], "left")
    attrs = F.to_json(F.struct(
        F.lit("GRIB2").alias("source_format"), F.col("object").cast("string").alias("source_uri"),
        F.coalesce("_notes", F.array().cast("array<string>")).alias("diagnostics"),
    ))
    head = F.array(F.lit('".zgroup":{"zarr_format":2}'), F.concat(F.lit('".zattrs":'), attrs))
    all_pairs = F.concat(head, F.coalesce("_pairs", F.array().cast("array<string>")))
    text = F.concat(F.lit('{"version":1,"refs":{'), F.array_join(all_pairs, ","), F.lit("}}"))
    return both.select("object", "shard", text.alias("text"))


def write_manifests(documents: DataFrame, path: str, packed: bool = False) -> None:
    """One text file per document, below a folder per object and shard; or many documents to a file, ``packed``.

    Every file costs the driver and the file system the same, however small, so many small documents are best packed.
    """
    if packed:
        write_documents(documents.select(F.col("object").cast("string").alias("name"), "text"), path)
        return
    documents.select("object", "shard", "text").repartition("object", "shard").write.mode("overwrite").partitionBy(
        "object", "shard"
    ).text(path)
