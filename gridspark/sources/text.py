"""Text sources: index files and colour palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import cut_lineage, lookup_join
from ..operators.ordered import number_rows


def numbered_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of all matching files with their 1-based number: path, line, text.

    Large files are read in several splits.  A first pass counts the lines of each split; a line's
    number is its place in its split plus the lines of the splits before.  The text itself
    is neither written, sorted nor shuffled.
    """
    lines = spark.read.text(pattern).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_seq"), F.col("value").alias("text"),
    )
    before = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    # one row per split; the lines of a split follow each other in one task
    splits = lines.groupBy("path", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    splits = cut_lineage(splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    numbered = lookup_join(lines, splits, ["path", "_at"], "inner")
    return numbered.select("path", (F.col("_before") + F.col("_seq") - F.col("_first") + 1).alias("line"), "text")


#: Compressed bytes of a row group of packed documents, and plain bytes after which a page is compressed.  A reader may
#: hold the plain text of a whole row group at once, and JSON is some ten to thirty times as long as its compressed form.
GROUP_BYTES, PAGE_BYTES = 1 << 20, 1 << 18


def write_documents(docs: DataFrame, path: str) -> None:
    """Write small documents (``name``, ``text``) as rows of Parquet files, many to a file.

    There are as many files as ``docs`` has partitions, so a document costs no file of its own.
    Row groups are small, and sizes are looked at from the first document on, not from the hundredth.
    """
    sizes = {"parquet.block.size": GROUP_BYTES, "parquet.page.size": PAGE_BYTES}
    checks = {"parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    docs.select("name", "text").write.mode("overwrite").options(compression="zstd", **sizes, **checks).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents that :func:`write_documents` wrote: name, text."""
    return spark.read.schema("name STRING, text STRING").parquet(path)


def document_lines(docs: DataFrame) -> DataFrame:
    """Lines of documents (``name``, ``text``) with their 1-based number, as :func:`numbered_lines` gives them: path, line, text."""
    # a line end closes a line, it does not open one more
    lines = F.split(F.regexp_replace("text", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)
    return docs.filter("text <> ''").select(F.col("name").alias("path"), F.posexplode(lines).alias("_i", "text")).select(
        "path", (F.col("_i") + 1).cast("bigint").alias("line"), "text"
    )


def read_idx(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of index files for ``parse_idx``: object, line, text."""
    return numbered_lines(spark, pattern).withColumnRenamed("path", "object")


def parse_palettes(lines: DataFrame) -> DataFrame:
    """Palettes out of lines (``path``, ``line``, ``text``): name, idx, red, green, blue.

    ``#`` starts a comment and blank lines are skipped.  A file with any line that is not
    three numbers of 0..255, or with fewer than two colours, is rejected as a whole.
    """
    text = F.trim(F.regexp_replace("text", "#.*$", ""))
    rows = lines.withColumn("_t", text).filter("_t <> ''")
    parts = F.split("_t", r"\s+")
    byte = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"^\+?[0-9]{1,5}$"), F.get(parts, F.lit(i)).try_cast("int"))
    rows = rows.withColumn("red", byte(0)).withColumn("green", byte(1)).withColumn("blue", byte(2))
    good = (F.size(parts) == 3)
    for c in ("red", "green", "blue"):
        good = good & F.coalesce(F.col(c) <= 255, F.lit(False))
    rows = rows.withColumn("_ok", good)
    sound = rows.groupBy("path").agg(F.bool_and("_ok").alias("_all"), F.count(F.lit(1)).alias("_n")).filter("_all AND _n >= 2")
    kept = rows.join(sound.select("path"), "path", "left_semi")
    numbered = number_rows(kept, ["path"], [F.col("line")], "_k")
    name = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    return numbered.select(name.alias("name"), (F.col("_k") - 1).cast("int").alias("idx"), "red", "green", "blue")


def read_palettes(spark: SparkSession, pattern: str) -> DataFrame:
    return parse_palettes(numbered_lines(spark, pattern))
