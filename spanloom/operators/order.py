"""Row order on a distributed table.

A DataFrame has no order, so every operator here takes an explicit, unique,
non-null order key, numeric or text; repeated and missing keys are an error. The
input is read several times, so a derived one should be stored. Rows are cut into buckets of neighbouring keys; only a
summary with one row per bucket is ever ordered as a whole. No window runs over
the table without a partition key.

How many rows a bucket holds follows from the data (quantiles of the key, long rows
weighing more), so gaps or clusters in the key, a dominant language or a few huge texts
do not unbalance it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.binding import let
from spanloom.session import broadcast_if_small, cut_lineage, row_bytes

# A bucket is the unit of work: small enough to sort in memory, and there are
# several per shuffle partition so that partitions come out even.
ROWS_PER_BUCKET = 8_192
MIN_ROWS_PER_BUCKET = 128
BUCKETS_PER_PARTITION = 4
# The bucket summary must fit in one task and its bounds on the driver; beyond this
# many buckets a bucket takes more rows instead.
MAX_BUCKETS = 262_144
# Rows weigh by their bytes too, so that a bucket of long texts holds fewer of them.
BYTES_PER_BUCKET = 64 << 20
# Size of the quantile sketch: its rank error is about 1.5 / SKETCH of the table.
SKETCH = 32_768
# Text keys are told apart by at most so many times eight bytes.
MAX_PREFIX = 64

BUCKET = "_bucket"
HOME = "_home"


def bucket_bounds(
    df: DataFrame, key: str, rows_per_bucket: int, max_buckets: int = MAX_BUCKETS
) -> list:
    """Inner bounds of key buckets with at most about ``rows_per_bucket`` rows and
    ``BYTES_PER_BUCKET`` bytes each.

    One aggregate counts the rows, refuses missing keys, and sums the keys up in a
    mergeable quantile sketch in which a row counts once and again for every so many bytes
    of its texts and arrays. The bounds are read off the sketch without a job. The
    sketch decides how even the buckets are, never the result. Numbers beyond 2^53 are
    told apart when the key is a whole number. Text is cut at prefixes of eight bytes;
    where one of them holds a bucket's worth, another pass looks at the next eight.
    """
    if rows_per_bucket <= 0:
        raise ValueError("rows_per_bucket must be positive")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text, kind = _is_text(df, key), df.schema[key].dataType
    sketch = "bigint" if text or isinstance(kind, T.IntegralType) else "double"
    unit = max(1, BYTES_PER_BUCKET // rows_per_bucket)
    sized = [f for f in df.schema if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))]
    heavy = F.lit(0).cast("long") if not sized else (row_bytes(df.select(*[f"`{f.name}`" for f in sized])) / unit).cast("long")
    value = F.hex(F.col(key).cast("binary")) if text else F.col(key)
    rows = df.select(value.alias("_k"), (1 + heavy).cast("int").alias("_w"))
    code = _code(F.col("_k"), 0) if text else F.col("_k").cast(sketch)

    def bounds_of(coded: DataFrame, least: int, by: list[str]) -> list[tuple]:
        """Per group: rows, missing keys and sketch, and the codes at the bounds."""
        weighed = coded.select(*by, "_k", F.posexplode(F.array_repeat("_c", F.col("_w"))).alias("_at", "_c"))
        found = weighed.groupBy(*by).agg(
            F.count(F.lit(1)).alias("weight"),
            F.count_if(F.col("_at") == 0).alias("rows"),
            F.count_if(F.col("_c").isNull()).alias("missing"),
            getattr(F, f"kll_sketch_agg_{sketch}")("_c", F.lit(SKETCH)).alias("s"),
        )
        out = []
        for r in found.collect():
            buckets = min(max_buckets, max(min(least, r.rows // MIN_ROWS_PER_BUCKET), math.ceil(r.weight / rows_per_bucket)))
            out.append((r, _quantiles(df.sparkSession, sketch, r.s, buckets) if buckets > 1 and not r.missing else []))
        return out

    [(top, found)] = bounds_of(rows.withColumn("_c", code), BUCKETS_PER_PARTITION * partitions, [])
    if top.missing:
        raise ValueError(f"the order key {key} has missing values")
    if not text:
        return sorted(set(found))

    bounds, crowded = _prefixes("", found)
    depth = 16
    while crowded and depth < 16 * MAX_PREFIX:
        inside = rows.withColumn("_p", F.substring("_k", 1, depth)).where(F.col("_p").isin(sorted(crowded)) & (F.length("_k") > depth))
        deeper = bounds_of(inside.withColumn("_c", _code(F.col("_k"), depth)), 1, ["_p"])
        crowded = set()
        for r, found in deeper:
            more, full = _prefixes(r["_p"], found)
            bounds |= more
            crowded |= full
        depth += 16
    return sorted(bounds)


def _quantiles(spark: SparkSession, kind: str, sketch: bytearray, buckets: int) -> list:
    """The inner bounds of so many buckets; an expression over constants, which runs no job."""
    ranks = ",".join(repr(i / buckets) for i in range(1, buckets))
    return spark.sql(
        f"SELECT kll_sketch_get_quantile_{kind}(s, cast(split('{ranks}', ',') AS array<double>)) AS q"
        f" FROM VALUES (X'{bytes(sketch).hex()}') AS t(s)"
    ).first().q


def _code(digits: Column, at: int) -> Column:
    """Eight bytes from hexadecimal digits as a bigint that orders like them."""
    part = F.rpad(F.substring(digits, at + 1, 16), 16, "0")
    return (F.conv(part, 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def _prefixes(before: str, codes: Sequence[int]) -> tuple[set[str], set[str]]:
    """The bounds as hexadecimal digits, and those prefixes that fill a bucket alone."""
    digits = [before + f"{c + 2**63:016X}" for c in codes]
    crowded = {a for a, b in zip(digits, digits[1:]) if a == b}

    def trimmed(d: str) -> str:
        while d.endswith("00"):
            d = d[:-2]
        return d

    return {trimmed(d) for d in digits}, crowded


def _is_text(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, T.StringType)


def with_bucket(df: DataFrame, key: str, bounds: Sequence) -> DataFrame:
    """Adds the bucket number of ``key``; monotone in the key."""
    if _is_text(df, key):
        # the order of hexadecimal digits is that of bytes; binary search in a constant array
        cuts = F.split(F.lit(",".join(bounds)), ",")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

        def place(digits: Column) -> Column:
            return F.aggregate(
                steps,
                F.lit(0),
                lambda at, step: F.when(
                    (at + step <= len(bounds)) & (F.get(cuts, at + step - 1) <= digits), at + step
                ).otherwise(at),
            )

        if not bounds:
            return df.withColumn(BUCKET, F.lit(0))
        digits = F.coalesce(F.hex(F.col(key).cast("binary")), F.lit(""))
        return df.withColumn(BUCKET, let(digits, place))
    # whole numbers that doubles cannot tell apart share a bound
    splits = [-math.inf, *sorted({float(b) for b in bounds} or {0.0}), math.inf]
    cut = Bucketizer(splits=splits, inputCol=key, outputCol=BUCKET).transform(df)
    return cut.withColumn(BUCKET, F.col(BUCKET).cast("int"))


def order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def over_buckets(by: Sequence[str]):
    """Window over the bucket summary, the only table ordered as a whole."""
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(BUCKET)


def _differs_from_previous(value: str, window) -> Column:
    return (F.row_number().over(window) == 1) | ~F.col(value).eqNullSafe(
        F.lag(value).over(window)
    )


def join_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe join of the summary; broadcast only if measured small."""
    small, _ = broadcast_if_small(summary)
    renamed = small.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        *[c for c in summary.columns if c not in keys],
    )
    on = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    return rows.join(renamed, on).drop(*[f"_s_{k}" for k in keys])


def ordered_groups(
    df: DataFrame,
    order: str | Sequence[str],
    span: int = 1,
    by: Sequence[str] = (),
    runs_of: str | None = None,
    idx: str = "idx",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """Index the rows and put each group of ``span`` neighbours in one place.

    Adds ``idx`` (0-based position per ``by``) and ``_home``. All rows with the
    same ``idx div span`` share their ``_home``, and the result is partitioned
    by ``(*by, _home)``, so grouping or windowing by those needs no further
    shuffle. With ``runs_of`` only the first row of each run of equal values is
    kept and indexed; the very first row is compared with the very last one.

    The whole rows are shuffled once. A first pass over the narrow key columns
    finds, per bucket, the first row that starts a group; rows before it go to
    the bucket where their group started.
    """
    if span <= 0:
        raise ValueError("span must be positive")
    order = [order] if isinstance(order, str) else list(order)
    by = list(by)
    keys = [*by, BUCKET]
    rows = with_bucket(df, order[0], bucket_bounds(df, order[0], rows_per_bucket, max_buckets))

    summary = _group_starts(rows, order, span, by, runs_of)
    routed = (
        join_summary(rows, summary, keys)
        .withColumn("_own", order_key(order) >= F.col("_start"))
        .withColumn(HOME, F.when(F.col("_own"), F.col(BUCKET)).otherwise(F.col("_prev_home")))
        .withColumn("_base", F.when(F.col("_own"), F.col("_base")).otherwise(F.col("_prev_base")))
        .where(F.col(HOME).isNotNull())
    )
    local = Window.partitionBy(*by, HOME).orderBy(*order)
    if runs_of is not None:
        routed = routed.withColumn("_new", _differs_from_previous(runs_of, local)).where("_new")
    return routed.withColumn(
        idx, F.col("_base") + F.row_number().over(local).cast("long") - 1
    ).select(*df.columns, idx, HOME)


def _refuse_repeats(heads: DataFrame, order: Sequence[str]) -> None:
    bad = heads.where((F.col("_repeats") > 0) | (F.col("_missing") > 0)).first()
    if bad is not None:
        raise ValueError(f"the order key {list(order)} has repeated or missing values")


def _group_starts(rows, order, span, by, runs_of) -> DataFrame:
    """Per bucket: where its first own group starts, at which index, and where
    earlier rows belong. Buckets that lie within one run have no row to keep and
    are left out, so that a run holding much of the table is not shuffled.

    What is ordered as a whole has a few numbers per bucket, whatever ``span`` is.
    """
    keys = [*by, BUCKET]
    key = order_key(order)
    local = Window.partitionBy(*keys).orderBy(*order)
    mark = F.lit(None).cast("binary") if runs_of is None else F.unhex(F.sha2(F.col(runs_of), 256))
    narrow = rows.select(*keys, *[c for c in order if c not in keys], mark.alias("_mark"))
    new = F.lit(True) if runs_of is None else _differs_from_previous("_mark", local)
    missing = F.lit(False)
    for c in order:
        missing = missing | F.col(c).isNull()
    ranked = (
        narrow.withColumn("_new", new)
        .withColumn("_key", key)
        .withColumn("_same", F.coalesce(F.col("_key") == F.lag("_key").over(local), F.lit(False)))
        .withColumn("_null", missing)
        .withColumn("_rank", F.sum(F.col("_new").cast("long")).over(local))
        .select(*keys, "_key", "_mark", "_new", "_same", "_null", "_rank")
    )
    if runs_of is None and span == 1:
        # every row is a group of its own, so the first one of a bucket starts it
        return _single_starts(ranked, keys, order, by)
    ranked = cut_lineage(ranked)
    heads = ranked.groupBy(*keys).agg(
        F.sum(F.col("_new").cast("long")).alias("_n"),
        F.count_if("_same").alias("_repeats"),
        F.count_if("_null").alias("_missing"),
        F.min_by("_mark", "_key").alias("_first"),
        F.max_by("_mark", "_key").alias("_last"),
    )
    w = over_buckets(by)
    if runs_of is None:
        heads = heads.withColumn("_keep_first", F.lit(True))
    else:
        before = F.when(
            F.row_number().over(w) == 1,
            F.last("_last").over(
                w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        ).otherwise(F.lag("_last").over(w))
        heads = heads.withColumn("_keep_first", ~F.col("_first").eqNullSafe(before))
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        heads.withColumn("_n", F.col("_n") - (~F.col("_keep_first")).cast("int"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_skip", F.pmod(-F.col("_offset"), F.lit(span)))
        # the rank of the first row of the bucket's first own group
        .withColumn("_want", F.col("_skip") + 1 + (~F.col("_keep_first")).cast("int"))
    )
    heads = cut_lineage(
        heads.select(*keys, "_n", "_offset", "_skip", "_want", "_repeats", "_missing")
    )
    _refuse_repeats(heads, order)
    found = (
        join_summary(ranked.where("_new"), heads.select(*keys, "_want"), keys)
        .where("_rank = _want")
        .select(*[F.col(k).alias(f"_f_{k}") for k in keys], F.col("_key").alias("_start"))
    )
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_f_{k}"))
    summary = (
        heads.join(found, on, "left")
        .withColumn("_base", F.when(F.col("_start").isNotNull(), F.col("_offset") + F.col("_skip")))
        .withColumn(
            "_prev_home",
            F.last(F.when(F.col("_start").isNotNull(), F.col(BUCKET)), True).over(earlier),
        )
        .withColumn("_prev_base", F.last("_base", True).over(earlier))
        .where(F.col("_n") > 0)
        .select(*keys, "_start", "_base", "_prev_home", "_prev_base")
    )
    return cut_lineage(summary)


def _single_starts(ranked: DataFrame, keys, order, by) -> DataFrame:
    heads = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("_same").alias("_repeats"),
        F.count_if("_null").alias("_missing"),
        F.min("_key").alias("_start"),
    )
    earlier = over_buckets(by).rowsBetween(Window.unboundedPreceding, -1)
    summary = cut_lineage(
        heads.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    )
    _refuse_repeats(summary, order)
    return summary.select(
        *keys,
        "_start",
        "_base",
        F.lit(None).cast("int").alias("_prev_home"),
        F.lit(None).cast("long").alias("_prev_base"),
    )


def row_index(
    df: DataFrame,
    order: str | Sequence[str],
    by: Sequence[str] = (),
    idx: str = "idx",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """0-based position of every row in the given order, per ``by``."""
    return ordered_groups(df, order, 1, by, None, idx, rows_per_bucket, max_buckets).drop(HOME)


def dedup_runs(
    df: DataFrame,
    order: str | Sequence[str],
    value: str = "context",
    by: Sequence[str] = (),
    idx: str = "idx",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """Keeps a row if ``value`` differs from the previous row's.

    The first row is compared with the last, so a table holding one repeated
    value yields no rows. Survivors are indexed anew.
    """
    return ordered_groups(df, order, 1, by, value, idx, rows_per_bucket, max_buckets).drop(HOME)


def span_group(idx: str, span: int) -> Column:
    """Number of the group of ``span`` neighbours that position ``idx`` falls in."""
    if span <= 0:
        raise ValueError("span must be positive")
    return F.expr(f"`{idx}` div {int(span)}")


def split_percent(
    df: DataFrame, key: str, percent: float, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Leading ``percent`` of the rows in key order; the count is rounded half up.

    Only the key of the last row to keep is looked up, in one bucket; the rows
    themselves pass a plain comparison that reaches the scan.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be between 0 and 100")
    keys = with_bucket(df.select(key), key, bucket_bounds(df.select(key), key, rows_per_bucket))
    sizes = keys.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    w = over_buckets([])
    all_rows = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    through = sizes.select(
        BUCKET,
        "_n",
        F.sum("_n").over(w).alias("_through"),
        F.floor(F.sum("_n").over(all_rows) * F.lit(percent) / 100 + 0.5).alias("_want"),
    )
    hit = (
        through.where((F.col("_want") > F.col("_through") - F.col("_n"))
                      & (F.col("_want") <= F.col("_through")))
        .select(BUCKET, (F.col("_want") - F.col("_through") + F.col("_n")).alias("_rank"))
        .first()
    )
    if hit is None:
        return df.where(F.lit(False))
    in_bucket = keys.where(F.col(BUCKET) == hit[BUCKET]).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(BUCKET).orderBy(key))
    )
    last = in_bucket.where(F.col("_rn") == hit["_rank"]).first()[key]
    if keys.where((F.col(BUCKET) == hit[BUCKET]) & (F.col(key) == F.lit(last))).count() > 1:
        raise ValueError(f"the order key {key} has repeated values")
    return df.where(F.col(key) <= F.lit(last))


def head_rows(df: DataFrame, order: str | Sequence[str], n: int = 3) -> DataFrame:
    """The first ``n`` rows in order (planned as a top-n)."""
    order = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*order).limit(n)


def row_at(df: DataFrame, i: int, idx: str = "idx") -> DataFrame:
    """The row at position ``i`` of an indexed table."""
    return df.where(F.col(idx) == i)
