"""Session helpers: shared scratch folder, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A broadcast side must be measured below these bounds; beyond them the join
# is left to Spark, which shuffles both sides.
BROADCAST_ROWS = 4_000_000
BROADCAST_BYTES = 256 * 1024 * 1024

# An Arrow batch is cut at so many bytes; Spark's own bound is 10,000 rows, whatever their texts.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession | None = None, size: int = BATCH_BYTES) -> None:
    """Bound the bytes of Arrow batches in the session, by default the active one, if nothing else does."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(size))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Where that is not set it is a folder in the warehouse, which executors share too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_spanloom").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/spanloom/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back.

    They survive the loss of executors, are computed once (an RDD checkpoint
    computes its last stage twice) and are read column by column.
    """
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """Size of a value: text by its octets, structs and arrays by their parts, the rest by 8 bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(value[f.name], f.dataType) for f in kind), F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        part = F.transform(value, lambda x: _bytes_of(x, kind.elementType))
        return F.coalesce(F.aggregate(part, F.lit(16).cast("long"), lambda a, x: a + x), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of these columns takes."""
    return sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16).cast("long"))


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, bool]:
    """Hint a broadcast only after measuring the side; returns (side, was hinted).

    The measurement is one aggregate over ``df``, which should be cheap to
    evaluate (a stored or checkpointed table).
    """
    rows, size = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    small = rows <= max_rows and (size or 0) <= max_bytes
    return (F.broadcast(df) if small else df), small
