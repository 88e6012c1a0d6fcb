"""Long contexts from neighbouring ones, with answer offsets moved along."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.spans import first_start
from spanloom.operators.order import HOME, MAX_BUCKETS, ROWS_PER_BUCKET, ordered_groups, span_group


def _starts_are_nested(df: DataFrame, answers: str) -> bool:
    starts = df.schema[answers].dataType["answer_start"].dataType
    return isinstance(starts.elementType, T.ArrayType)


def _indexed(df, span, order, context, by, rows_per_bucket, max_buckets) -> DataFrame:
    """Survivors of the run deduplication with group number and characters so far."""
    rows = ordered_groups(
        df, order, span, by, runs_of=context, rows_per_bucket=rows_per_bucket, max_buckets=max_buckets
    )
    so_far = Window.partitionBy(*by, HOME).orderBy(order)
    return rows.withColumn("group_id", span_group("idx", span)).withColumn(
        "_chars", F.sum(F.length(context).cast("long")).over(so_far)
    )


def concat_groups(
    df: DataFrame,
    span: int = 3,
    order: str = "seq",
    context: str = "context",
    answers: str = "answers",
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """One row per group: the joined context once, and its examples as ``members``.

    This is the form to store: exploding ``members`` repeats the context up to
    ``span`` times. Each member has the other columns of its row, its ``idx``
    and ``answers`` with the one re-based start.
    """
    by = list(by)
    rows = _indexed(df, span, order, context, by, rows_per_bucket, max_buckets)
    carried = [c for c in df.columns if c not in (*by, context)]
    grouped = rows.groupBy(*by, HOME, "group_id").agg(
        F.sort_array(
            F.collect_list(F.struct("idx", "_chars", F.col(context).alias("_text"), *carried))
        ).alias("_rows")
    )
    nested = _starts_are_nested(df, answers)
    ahead = F.get("_rows", 0)["_chars"] - F.length(F.get("_rows", 0)["_text"])

    def member(m):
        moved = m["_chars"] - F.length(m["_text"]) - F.col("_ahead")
        start = moved + first_start(m[answers]["answer_start"], nested)
        return F.struct(
            m["idx"].alias("idx"),
            *[m[c].alias(c) for c in carried if c != answers],
            F.struct(
                m[answers]["text"].alias("text"), F.array(start).alias("answer_start")
            ).alias(answers),
        )

    return grouped.withColumn("_ahead", ahead).select(
        *by,
        "group_id",
        F.array_join(F.transform("_rows", lambda m: m["_text"]), "").alias(context),
        F.transform("_rows", member).alias("members"),
    )


def concat_contexts(df: DataFrame, span: int = 3, **options) -> DataFrame:
    """Every surviving row with the joined context of its whole group and its
    answer start moved accordingly. Takes the options of ``concat_groups``."""
    groups = concat_groups(df, span, **options)
    rest = [c for c in groups.columns if c != "members"]
    return groups.select(*rest, F.explode("members").alias("_m")).select(*rest, "_m.*")


def rebase_answer_start(
    df: DataFrame,
    span: int = 3,
    order: str = "seq",
    context: str = "context",
    answers: str = "answers",
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """The rows without their context but with ``new_start``, the first answer
    start within the joined context. Only a digest and the length of a context
    are shuffled."""
    by = list(by)
    nested = _starts_are_nested(df, answers)
    narrow = df.select(
        *[c for c in df.columns if c != context],
        F.unhex(F.sha2(context, 256)).alias("_digest"),
        F.length(context).cast("long").alias("_length"),
    )
    rows = ordered_groups(
        narrow, order, span, by, runs_of="_digest", rows_per_bucket=rows_per_bucket, max_buckets=max_buckets
    ).withColumn("group_id", span_group("idx", span))
    in_group = Window.partitionBy(*by, HOME, "group_id").orderBy("idx")
    before = F.coalesce(
        F.sum("_length").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return rows.withColumn(
        "new_start", before + first_start(F.col(answers)["answer_start"], nested)
    ).drop(HOME, "_digest", "_length")


def join_group_context(
    df: DataFrame,
    span: int = 3,
    order: str = "seq",
    context: str = "context",
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """One row per group: its number of rows and the joined context. A short last
    group is kept."""
    by = list(by)
    rows = ordered_groups(
        df.select(*by, order, context),
        order, span, by, runs_of=context, rows_per_bucket=rows_per_bucket, max_buckets=max_buckets,
    )
    return (
        rows.withColumn("group_id", span_group("idx", span))
        .groupBy(*by, HOME, "group_id")
        .agg(F.sort_array(F.collect_list(F.struct("idx", context))).alias("_rows"))
        .select(
            *by,
            "group_id",
            F.size("_rows").cast("long").alias("n_rows"),
            F.array_join(F.transform("_rows", lambda m: m[context]), "").alias(context),
        )
    )
