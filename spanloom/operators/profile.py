"""Length profiles and row audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.order import ROWS_PER_BUCKET, ordered_groups

# Input lengths a model may have, and numbers of joined contexts.
LIMITS = (512, 1024, 2048, 4096)
SPANS = (1, 3, 5)


def span_stats(df: DataFrame) -> DataFrame:
    """Largest start position and number of rows."""
    return df.agg(
        F.max("start_positions").alias("max_start"), F.count(F.lit(1)).alias("n_rows")
    )


def row_lengths(df: DataFrame, question: str = "question", context: str = "context") -> DataFrame:
    """Adds the character lengths of question and context."""
    return df.withColumn("question_length", F.length(question).cast("long")).withColumn(
        "context_length", F.length(context).cast("long")
    )


def length_profile(
    df: DataFrame, length: Column, by: str = "lang", limits: Sequence[int] = LIMITS
) -> DataFrame:
    """Per ``by``: rows, mean and median length, and how many fit each limit.

    Rows are first counted per length, so the exact median is taken over the
    distinct lengths only.
    """
    counts = df.groupBy(by, length.cast("long").alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(by).agg(
        F.sum("_n").alias("n_rows"),
        (F.sum(F.col("_len") * F.col("_n")) / F.sum("_n")).alias("mean_length"),
        F.percentile("_len", F.lit(0.5), F.col("_n")).alias("median_length"),
        F.max("_len").alias("max_length"),
        *[
            F.sum(F.when(F.col("_len") <= m, F.col("_n")).otherwise(0)).alias(f"fit_{m}")
            for m in limits
        ],
    )


def concat_fit(
    df: DataFrame,
    n_tokens: Column,
    order: str = "seq",
    context: str = "context",
    by: Sequence[str] = ("lang",),
    spans: Sequence[int] = SPANS,
    limits: Sequence[int] = LIMITS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """For each number of joined contexts: groups, and how many fit each limit.

    Only a digest and the token count of a context are shuffled. One index
    serves all spans; groups are summed per span with map-side combining.
    """
    by = list(by)
    narrow = df.select(
        *by, order, F.sha2(context, 256).alias("_digest"), n_tokens.cast("long").alias("_n")
    )
    rows = ordered_groups(
        narrow, order, 1, by, runs_of="_digest", rows_per_bucket=rows_per_bucket
    )
    groups = (
        rows.select(*by, "idx", "_n", F.explode(F.array(*map(F.lit, spans))).alias("span"))
        .groupBy(*by, "span", F.expr("idx div span").alias("_g"))
        .agg(F.sum("_n").alias("_len"))
    )
    return groups.groupBy(*by, "span").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.max("_len").alias("max_tokens"),
        *[F.count_if(F.col("_len") <= m).alias(f"fit_{m}") for m in limits],
    )


def row_audit(df: DataFrame, reason: Column, by: Sequence[str] = ("lang",)) -> DataFrame:
    """Rows per reason; ``reason`` is NULL (reported as ``kept``) for rows that stay."""
    return df.groupBy(*by, F.coalesce(reason, F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
