"""Prepared features that are written once and reused, and metric reports."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(spark: SparkSession, path: str | list[str]) -> str:
    """Identifies the files of a table by path, size and modification time.

    One row per file comes from the listing; no file is opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("path").alias("p"), F.col("length").alias("s"), F.col("modificationTime").alias("m"))
    )
    n, bits = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("p", "s", "m"))).first()
    return f"{n}-{(bits or 0) & (2**64 - 1):016x}"


def feature_path(
    folder: str, tokenizer: str, block_size: int, name: str, inputs: str, **settings
) -> str:
    """Where features of these inputs and settings are kept.

    ``settings`` are all further arguments that the features depend on (policy,
    number of joined contexts, fingerprint of a vocabulary, ...).
    """
    path = f"{folder.rstrip('/')}/cached_{tokenizer}_{block_size}_{name}_{inputs}"
    if not settings:
        return path
    said = json.dumps(settings, sort_keys=True, default=str)
    return f"{path}_{hashlib.sha256(said.encode()).hexdigest()[:16]}"


def materialize_features(
    spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False
) -> DataFrame:
    """Reads the features at ``path``, or makes and writes them first.

    Every write goes to a folder of its own below ``path``; a pointer to it is added last.
    A reader follows the newest pointer, so it never sees a write that is under way or was
    cut short, and one that began before an overwrite goes on with the rows it began with.
    Of writers at the same time the same one wins for all readers. Earlier versions stay
    until the folder is cleaned.
    """
    pointers, schema = f"{path}/pointers", "n long, version string"

    def newest():
        try:
            return spark.read.schema(schema).parquet(pointers).orderBy(F.desc("n"), F.desc("version")).first()
        except AnalysisException:  # nothing written yet
            return None

    found = newest()
    if found is None or overwrite:
        version = uuid.uuid4().hex
        make().write.parquet(f"{path}/versions/{version}")
        pointer = spark.createDataFrame([(found.n + 1 if found else 0, version)], schema)
        pointer.coalesce(1).write.mode("append").parquet(pointers)
        found = newest()
    return spark.read.parquet(f"{path}/versions/{found.version}")


def metrics_report(metrics: DataFrame) -> DataFrame:
    """``metric, value`` from the columns of a one-row table, sorted by name."""
    names = sorted(metrics.columns)
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return metrics.select(F.explode(F.array(*pairs)).alias("m")).select("m.*").orderBy("metric")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """``metric, value`` from a written report."""
    parts = F.split("value", " = ", 2)
    return spark.read.text(path).select(
        F.get(parts, 0).alias("metric"), F.get(parts, 1).cast("double").alias("value")
    )


def write_report(report: DataFrame, path: str) -> None:
    """Writes ``metric = value`` lines; a report is a handful of rows."""
    lines = report.orderBy("metric").select(
        F.concat_ws(" = ", "metric", F.col("value").cast("string")).alias("line")
    )
    lines.coalesce(1).write.mode("overwrite").text(path)
