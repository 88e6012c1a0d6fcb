"""Labelling QA rows as they arrive.

Only row-wise operators run on a stream; those that need a total order do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spanloom.plans.qa_features import label_spans
from spanloom.operators.rows import filter_valid_spans
from spanloom.session import scratch_path


def stream_features(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    max_length: int = 512,
    policy: str = "null",
    limit: int | None = None,
) -> DataFrame:
    """Labelled rows of the Parquet files that appear under ``path``."""
    arriving = spark.readStream.schema(schema).parquet(path)
    return filter_valid_spans(label_spans(arriving, max_length, policy, limit))


def write_available(rows: DataFrame, out: str, checkpoint: str | None = None) -> StreamingQuery:
    """Writes what has arrived so far; run again with the same checkpoint to go on."""
    checkpoint = checkpoint or scratch_path(rows.sparkSession, "stream")
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
