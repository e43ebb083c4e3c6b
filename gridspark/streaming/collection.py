"""Collections that grow: incremental catalogue and incremental plane statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import GridError, GridSet
from ..operators.catalog import leading_axes, with_dim_map
from ..operators.collection import COMPARED, differences_from, duplicate_labels, missing_notes, timeline
from ..operators.decode import decode, finite_value
from ..operators.derive import Derived, derived_vars
from ..operators.joins import cut_lineage, lookup_join

#: One row per dataset and variable; a dataset that failed to load has ``error`` set.
ARRIVALS = (
    "dataset_id INT, pos INT, variable STRING, dims ARRAY<STRUCT<dim: STRING, length: INT, role: STRING>>, "
    "numeric BOOLEAN, units STRING, long_name STRING, standard_name STRING, format STRING, path STRING, "
    "labels ARRAY<STRING>, error STRING"
)
#: Arrivals that one task takes, at most as many tasks as shuffle partitions.
ROWS_PER_TASK = 10_000
#: Tables that :func:`latest` gives.
TABLES = ("frames", "diagnostics", "timeline", "progress")


def catalogue(arrivals: DataFrame) -> tuple[GridSet, DataFrame]:
    """Catalogue tables and labels of the datasets that loaded."""
    good = arrivals.filter("error IS NULL")
    dims = good.select("dataset_id", F.explode("dims").alias("d")).select("dataset_id", "d.*").dropDuplicates(["dataset_id", "dim"])
    vars_ = good.select(
        "dataset_id", "pos", "variable", F.transform("dims", lambda d: d["dim"]).alias("dims"), "numeric", "units",
        "long_name", "standard_name",
    )
    datasets = good.select("dataset_id", "path", "format", F.col("path").alias("identity")).dropDuplicates(["dataset_id"])
    labels = good.select("variable", "dataset_id", F.posexplode("labels").alias("t", "label"))
    return GridSet(cells=None, vars=vars_, dims=dims, datasets=datasets), labels


def _with_own_dims(rows: DataFrame) -> DataFrame:
    """Arrivals with the names of their dimensions and ``dim_map``: a row holds what its own dimensions are, so none is joined."""
    once = F.filter("dims", lambda d, i: F.array_position("dims.dim", d["dim"]) == i + 1)
    sizes = F.map_from_entries(F.transform(once, lambda d: F.struct(d["dim"], F.struct(d["role"], d["length"]))))
    return rows.withColumn("dim_map", sizes).withColumn("dims", F.col("dims.dim"))


def _frames(good: DataFrame) -> DataFrame:
    """One row per arrival and local time step, as :func:`gridspark.operators.collection.frames`, out of the row alone."""
    rows = leading_axes(_with_own_dims(good), None)
    steps = F.explode(F.sequence(F.lit(0), F.greatest("n_time", F.lit(1)) - 1)).alias("t")
    label = F.coalesce(F.get("labels", "t"), F.concat(F.lit("t="), F.col("t").cast("string")))
    return rows.select("dataset_id", "variable", steps, "labels", "path").select(
        "dataset_id", "variable", "t", label.alias("label"), F.col("path").alias("identity")
    )


def _differences(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """How arrivals differ from the first one of their variable (``firsts``); only datasets with a first one are gathered."""
    homes = lookup_join(rows, firsts.select("dataset_id").distinct(), ["dataset_id"], "left_semi").unionByName(firsts)
    whole = homes.select("dataset_id", F.explode("dims").alias("d")).select("dataset_id", "d.*").dropDuplicates(["dataset_id", "dim"])
    own = _with_own_dims(firsts).withColumnRenamed("dim_map", "_own")
    # what a dataset's other variables tell of a dimension counts where the first arrival has none of that name
    others = F.map_filter("dim_map", lambda d, _: ~F.coalesce(F.map_contains_key("_own", d), F.lit(False)))
    held = with_dim_map(own, whole).withColumn("dim_map", F.coalesce(F.map_concat(others, "_own"), "dim_map"))
    first = held.select("variable", F.col("dataset_id").alias("reference_id"), F.struct("format", *COMPARED, "dim_map").alias("_r"))
    found = _with_own_dims(rows).select("variable", "dataset_id", "format", *COMPARED, "dim_map")
    return differences_from(found, cut_lineage(first)).select("variable", "dataset_id", "message")


def derived_arrivals(arrivals: DataFrame, formulas: list[Derived]) -> DataFrame | None:
    """Arrivals of the formulas' results, for the datasets that can evaluate them; labels are those of the first reference.

    Formulas are bound against what the files hold, so none sees another's result.
    """
    gs, _ = catalogue(arrivals)
    names = gs.vars.select("variable").distinct()
    out = []
    for d in formulas:
        if names.filter(F.col("variable").isin([r.name for r in d.refs])).count() < len({r.name for r in d.refs}):
            continue  # a reference is not there yet
        rows = derived_vars(gs, d)
        sizes = gs.dims.groupBy("dataset_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", F.struct("length", "role")))).alias("_m"))
        source = arrivals.filter((F.col("variable") == d.refs[0].name) & F.col("error").isNull())
        named = source.select("dataset_id", "format", "path", F.col("labels").alias("_labels")).dropDuplicates(["dataset_id"])
        rows = rows.join(sizes, "dataset_id").join(named, "dataset_id", "left")
        dims = F.transform("dims", lambda x: F.struct(
            x.alias("dim"), F.try_element_at("_m", x)["length"].alias("length"), F.try_element_at("_m", x)["role"].alias("role")
        ))
        over_time = d.over is not None and d.over[0] == "time"
        out.append(rows.select(
            "dataset_id", F.lit(10_000).alias("pos"), "variable", dims.alias("dims"), "numeric", "units", "long_name", "standard_name", "format", "path",
            F.lit(None).cast("array<string>").alias("labels") if over_time else F.col("_labels").alias("labels"), F.lit(None).cast("string").alias("error"),
        ))
    return reduce(lambda a, b: a.unionByName(b), out) if out else None


def _spread(batch: DataFrame) -> DataFrame:
    """The batch in partitions of limited size: a file that arrives may be one task, and so would be all that is joined to it."""
    most = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(most, batch.count() // ROWS_PER_TASK + 1)
    return batch.repartition(parts) if parts > 1 else batch


def update_collection(formulas: list[Derived] | None, sink: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: store the batch, its frames and how it differs from what was there.

    The state that survives batches is one row per variable, its first dataset (``first``), and the arrivals
    of the variables that formulas read (``inputs``).  A batch reads itself and that state.  Only
    where a dataset comes before the first one of its variable are that variable's
    arrivals read again (``restarts``).  Every batch writes its own folders and overwrites
    them when it is retried, so a lost executor or a restart leaves the same tables.
    """
    needed = sorted({r.name for d in formulas or [] for r in d.refs})
    pinned = sorted({r.dataset for d in formulas or [] for r in d.refs if r.dataset is not None})

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def write(rows: DataFrame, table: str) -> DataFrame:
            path = f"{sink}/{table}/batch_id={batch_id}"
            rows.write.mode("overwrite").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        def before(table: str) -> DataFrame:
            """The rows of a table that earlier batches wrote; after a retry or restart, later ones do not count."""
            found = [n for n in _folders(spark, f"{sink}/{table}", "batch_id") if n < batch_id]
            rows = spark.createDataFrame([], f"{ARRIVALS}, batch_id INT")
            if found:
                rows = spark.read.schema(f"{ARRIVALS}, batch_id INT").option("basePath", f"{sink}/{table}").parquet(
                    *[f"{sink}/{table}/batch_id={n}" for n in (found[-1:] if table == "first" else found)]
                )
            return rows.drop("batch_id")

        new = write(_spread(batch), "arrivals")
        good = new.filter("error IS NULL AND variable IS NOT NULL")
        if formulas:
            inputs = write(good.filter(F.col("variable").isin(needed)), "inputs")
            held = before("inputs").unionByName(inputs)
            ids = good.select("dataset_id").distinct()
            # a pinned dataset is needed by all; if it arrives now, formulas bind for every dataset
            late = bool(pinned) and not inputs.filter(F.col("dataset_id").isin(pinned)).isEmpty()
            own = held if late else lookup_join(held, ids, ["dataset_id"], "left_semi").unionByName(
                lookup_join(held.filter(F.col("dataset_id").isin(pinned)), ids, ["dataset_id"], "left_anti")
            )
            derived = derived_arrivals(cut_lineage(own), formulas)
            if derived is not None:
                seen = before("derived").select("dataset_id", "variable").distinct()
                derived = write(lookup_join(derived, seen, ["dataset_id", "variable"], "left_anti").select(*new.columns), "derived")
                good = cut_lineage(good.unionByName(derived))
        write(_frames(good), "frames")
        old = before("first")
        whole = F.struct(*old.columns)
        both = old.unionByName(good.select(*old.columns))
        # the smallest number is hashed; the rows that hold it are few
        least = both.groupBy("variable").agg(F.min("dataset_id").alias("dataset_id"))
        heads = lookup_join(both, least, ["variable", "dataset_id"], "left_semi")
        firsts = write(heads.groupBy("variable").agg(F.min_by(whole, "dataset_id").alias("_f")).select("_f.*"), "first")
        moved = firsts.select("variable", F.col("dataset_id").alias("_now")).join(old.select("variable", F.col("dataset_id").alias("_was")), "variable")
        moved = write(moved.filter("_now < _was").select("variable"), "restarts")
        rows = good
        if not moved.isEmpty():
            past = before("arrivals").filter("error IS NULL").unionByName(before("derived"))
            rows = good.unionByName(lookup_join(past, moved, ["variable"], "left_semi"))
        write(_differences(rows, firsts), "differences")

    return run


def stream_collection(
    spark: SparkSession, source: str, sink: str, formulas: list[Derived] | None = None,
    files_per_batch: int | None = None, available_now: bool = False,
) -> StreamingQuery:
    """Follow a folder of arrival files and keep the collection tables under ``sink``."""
    reader = spark.readStream.schema(ARRIVALS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = reader.parquet(source).writeStream.foreachBatch(update_collection(formulas, sink)).option(
        "checkpointLocation", f"{sink}/_progress"
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, sink: str, table: str) -> DataFrame:
    """Current rows of a table.

    What depends on the whole collection (the order of frames, repeated labels, datasets that
    lack a variable) is worked out here, from the frames and the names of the arrivals.
    """
    arrivals = spark.read.schema(f"{ARRIVALS}, batch_id INT").parquet(f"{sink}/arrivals")
    if table == "progress":
        return arrivals.groupBy("dataset_id").agg(F.max_by(F.col("error").isNotNull(), "batch_id").alias("bad")).agg(
            F.count(F.when(~F.col("bad"), 1)).alias("loaded"), F.count(F.lit(1)).alias("finished")
        )
    steps = spark.read.parquet(f"{sink}/frames").drop("batch_id")
    if table == "frames":
        return steps
    if table == "timeline":
        return timeline(steps)
    if table != "diagnostics":
        raise GridError(f"unknown table {table!r}, use one of {', '.join(TABLES)}")
    restarts = spark.read.schema("variable STRING, batch_id INT").parquet(f"{sink}/restarts").groupBy("variable").agg(F.max("batch_id").alias("_since"))
    notes = lookup_join(spark.read.parquet(f"{sink}/differences"), restarts, ["variable"]).filter("_since IS NULL OR batch_id >= _since")
    twice = duplicate_labels(steps).select(
        "variable", "dataset_id",
        F.format_string(
            '%s: step %d of source %d repeats the label "%s" of step %d of source %d',
            F.col("variable"), F.col("t"), F.col("dataset_id"), F.col("label"), F.col("previous_t"), F.col("previous_dataset"),
        ).alias("message"),
    )
    # a failure to load holds until its dataset arrives again
    tried = arrivals.groupBy("dataset_id").agg(F.max("batch_id").alias("batch_id"))
    failed = lookup_join(arrivals.filter("error IS NOT NULL"), tried, ["dataset_id", "batch_id"], "left_semi").select(
        "variable", "dataset_id", F.concat(F.col("path"), F.lit(": "), F.col("error")).alias("message")
    )
    held = steps.select("variable", "dataset_id").distinct()
    lacking = missing_notes(GridSet(cells=None, vars=held)).select("variable", "dataset_id", "message")
    return notes.select("variable", "dataset_id", "message").unionByName(lacking).unionByName(twice).unionByName(failed)


def stream_stats(cells: DataFrame, attrs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Streaming plane statistics; state is one row of aggregates per plane.

    ``cells`` is a stream of packed cells.  Update mode emits the planes a batch touched.
    """
    x = finite_value()
    return decode(cells, attrs).groupBy(*(by or ["dataset_id", "variable", "t", "z"])).agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.count(x).alias("finite_count")
    )


#: Batches after which the updates are merged into a snapshot.
SNAPSHOT_EVERY = 20


def start_stats(
    stats: DataFrame, sink: str, available_now: bool = False, by: list[str] | None = None, snapshot_every: int = SNAPSHOT_EVERY
) -> StreamingQuery:
    """Write updated planes per batch; :func:`latest_stats` reads the current values.

    Every ``snapshot_every`` batches the last snapshot and the updates since are merged into the
    next one, so what a reader or the next merge reads does not grow with the history.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/stats/batch_id={batch_id}")
        if (batch_id + 1) % snapshot_every == 0:
            merged = _merged_stats(batch.sparkSession, sink, by, batch_id)
            merged.write.mode("overwrite").parquet(f"{sink}/snapshots/upto={batch_id}")

    writer = stats.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", f"{sink}/_stats")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _folders(spark: SparkSession, path: str, key: str) -> list[int]:
    """Numbers in the names of the folders ``key=number`` below a path that are written whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in system.listStatus(root)]
    whole = lambda p: system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(n.split("=")[1]) for p, n in names if n.startswith(f"{key}=") and whole(p))


def _merged_stats(spark: SparkSession, sink: str, by: list[str] | None, upto: int | None = None) -> DataFrame:
    """The last update of each plane: the newest snapshot and the batches after it, up to one of them."""
    keys = by or ["dataset_id", "variable", "t", "z"]
    bound = float("inf") if upto is None else upto
    old = [n for n in _folders(spark, f"{sink}/snapshots", "upto") if n < bound]
    start = old[-1] if old else -1
    batches = [n for n in _folders(spark, f"{sink}/stats", "batch_id") if start < n <= bound]
    parts = [spark.read.parquet(f"{sink}/snapshots/upto={start}").withColumn("_batch", F.lit(start))] if old else []
    if batches:
        found = spark.read.option("basePath", f"{sink}/stats").parquet(*[f"{sink}/stats/batch_id={n}" for n in batches])
        parts.append(found.withColumnRenamed("batch_id", "_batch"))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def latest_stats(spark: SparkSession, sink: str, by: list[str] | None = None) -> DataFrame:
    """Current statistics: the last update of each plane."""
    return _merged_stats(spark, sink, by)
