"""Seeded order and fixed-size batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.masking import seeded_key
from spanloom.operators.order import HOME, MAX_BUCKETS, ROWS_PER_BUCKET, ordered_groups, row_index, span_group


def shuffle_seeded(
    df: DataFrame,
    key: str,
    seed: int,
    idx: str = "pos",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """Adds each row's position in a reproducible shuffled order of the unique ``key``."""
    keyed = df.withColumn("_draw", seeded_key(seed, F.col(key)))
    return row_index(keyed, ["_draw", key], idx=idx, rows_per_bucket=rows_per_bucket, max_buckets=max_buckets).drop("_draw")


def make_batches(
    df: DataFrame,
    batch_size: int,
    columns: Sequence[str],
    order: str | Sequence[str] = "seq",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """``batch_id, n_rows`` and one array per column, stacked in order; the last
    batch may be short. A batch is the largest unit gathered."""
    order = [order] if isinstance(order, str) else list(order)
    needed = list(dict.fromkeys([*order, *columns]))
    rows = ordered_groups(
        df.select(*needed), order, batch_size, rows_per_bucket=rows_per_bucket, max_buckets=max_buckets
    ).withColumn("batch_id", span_group("idx", batch_size))
    return (
        rows.groupBy(HOME, "batch_id")
        .agg(F.sort_array(F.collect_list(F.struct("idx", *columns))).alias("_rows"))
        .select(
            "batch_id",
            F.size("_rows").cast("long").alias("n_rows"),
            *[F.col("_rows")[c].alias(c) for c in columns],
        )
    )
