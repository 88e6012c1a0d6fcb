"""Plain text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.session import broadcast_if_small, cut_lineage

MIN_SPLITS = "spark.sql.files.minPartitionNum"


def pin_splits(spark: SparkSession) -> None:
    """Fix how the session splits files, so that reading them again gives the same splits.

    Without it the split size follows the number of cores at that moment.
    """
    if spark.conf.get(MIN_SPLITS, None) is None:
        spark.conf.set(MIN_SPLITS, str(spark.sparkContext.defaultParallelism))


def read_text_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``seq, file, text``: the lines of UTF-8 files with their line ends.

    Concatenating ``text`` by ``seq`` gives the files one after the other, by
    path, as they are, but for Windows and old Mac line ends, which become
    single line feeds. A final line end is kept or missing as in the file: the
    lines' bytes and separators are compared with the file's size. Large files are
    split over tasks and read twice; only one row per split is stored. A missing
    path is an error. In compressed files every line gets a line end.
    """
    pin_splits(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    # One row per file split; only this is ordered as a whole.
    w = Window.partitionBy(F.lit(0)).orderBy("_f", "_b")
    whole = Window.partitionBy("_f")
    splits = cut_lineage(
        lines.groupBy(F.col("file").alias("_f"), F.col("_block").alias("_b"))
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.min("_at").alias("_first"),
            F.sum(F.octet_length("value") + 1).alias("_bytes"),
            F.first("_size").alias("_size"),
        )
        .withColumn(
            "_before",
            F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("_ends_file", ~F.lead("_f").over(w).eqNullSafe(F.col("_f")))
        .withColumn("_open", F.sum("_bytes").over(whole) == F.col("_size") + 1)
        .drop("_bytes", "_size")
    )
    side, _ = broadcast_if_small(splits)
    placed = lines.join(side, (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    at = F.col("_at") - F.col("_first")
    last = F.col("_ends_file") & F.col("_open") & (at == F.col("_rows") - 1)
    ended = F.when(last, F.col("value")).otherwise(F.concat("value", F.lit("\n")))
    return placed.select(
        (F.col("_before") + at).alias("seq"),
        "file",
        F.regexp_replace(ended, "\r\n?", "\n").alias("text"),
    )
