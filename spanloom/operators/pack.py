"""Cutting a corpus' token stream into blocks of equal size.

Texts follow each other in key order; the stream is cut every ``size`` tokens
and a tail shorter than that is dropped. A block may span texts, a text blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.binding import once
from spanloom.operators.order import (
    BUCKET,
    HOME,
    MAX_BUCKETS,
    ROWS_PER_BUCKET,
    bucket_bounds,
    join_summary,
    over_buckets,
    with_bucket,
)
from spanloom.session import cut_lineage

# Texts of few tokens are joined while their keys, whole numbers, agree but for so many bits;
# keys are unique, so that a run has at most 1,024 texts.
RUN_BITS = 10
SHORT = 16
# Joining must pay: so many texts a run at least.
TEXTS_PER_RUN = 16


def _joined(df: DataFrame, tokens: Column, key: str) -> tuple[DataFrame, Column, str]:
    """The rows, or one row per run of neighbours where all texts are short and keys dense.

    What follows works on rows, so a text of a token or two would cost as much as a long one.
    """
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        return df, tokens, key
    # a look at a few rows spares most tables the pass that decides; the result is the same either way
    if any((r.n or 0) > SHORT for r in df.select(F.size(tokens).alias("n")).take(100)):
        return df, tokens, key
    run = F.shiftright(F.col(key).cast("long"), RUN_BITS)
    rows, longest, runs = df.agg(
        F.count(F.lit(1)), F.max(F.size(tokens)), F.approx_count_distinct(run)
    ).first()
    if rows < TEXTS_PER_RUN * runs or (longest or 0) > SHORT:
        return df, tokens, key
    # a key's place in its run, beside the one token itself where no text has more
    single = (longest or 0) <= 1
    place = F.col(key).bitwiseAND(F.lit((1 << RUN_BITS) - 1)).cast("short").alias("_place")
    text = F.struct(place, (F.get(tokens, F.lit(0)) if single else tokens).alias("_t"))
    grouped = df.groupBy(run.alias("_run")).agg(
        F.sort_array(F.collect_list(F.when(F.size(tokens) > 0, text))).alias("_texts")
    )
    parts = F.transform("_texts", lambda x: x["_t"])
    joined = grouped.select("_run", (parts if single else F.flatten(parts)).alias("_tokens"))
    return cut_lineage(joined), F.col("_tokens"), "_run"


def _block_starts(counted: DataFrame, key: str, size: int) -> DataFrame:
    """Per bucket: the text holding its first block start, how many of that
    text's tokens lie before it, the block's number, and the bucket where
    earlier texts belong.

    Only sums per bucket are ordered as a whole; ``counted`` has one narrow row per
    text and is stored, as it is read twice.
    """
    counted = cut_lineage(counted)
    w = over_buckets([])
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = cut_lineage(
        counted.groupBy(BUCKET)
        .agg(F.sum("_n").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .withColumn("_skip", F.pmod(-F.col("_offset"), F.lit(size)))
    )
    until = F.sum("_n").over(Window.partitionBy(BUCKET).orderBy(key))
    placed = counted.withColumn("_end", until).withColumn("_begin", F.col("_end") - F.col("_n"))
    found = (
        join_summary(placed, sums.select(BUCKET, "_skip"), [BUCKET])
        .where((F.col("_begin") <= F.col("_skip")) & (F.col("_skip") < F.col("_end")))
        .select(BUCKET, F.col(key).alias("_start"), (F.col("_skip") - F.col("_begin")).alias("_cut"))
    )
    here = F.col("_start").isNotNull()
    return sums.join(found, BUCKET, "left").select(
        BUCKET,
        "_start",
        "_cut",
        F.when(here, F.expr(f"(_offset + _skip) div {size}")).alias("_base"),
        F.last(F.when(here, F.col(BUCKET)), True).over(earlier).alias("_prev_home"),
    )


def place_texts(
    df: DataFrame,
    key: str,
    n_tokens: Column,
    size: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """Puts each text where the blocks it takes part in are built.

    Adds ``_home``, the token range ``_from .. _to`` (exclusive; NULL for the
    text's end) the text gives to that home, and ``_base``, the number of the home's first block (set on
    the home's first text). Only texts over a home boundary occur twice. The
    texts are shuffled once; only counts are summed ahead of that.
    """
    if size <= 0:
        raise ValueError("block size must be positive")
    texts = with_bucket(df, key, bucket_bounds(df, key, rows_per_bucket, max_buckets))
    counted = (
        once(texts, _n=n_tokens.cast("long")).where(F.col("_n") > 0).select(BUCKET, key, "_n")
    )
    starts = cut_lineage(_block_starts(counted, key, size))
    joined = join_summary(texts, starts, [BUCKET])
    own = F.struct(
        F.col(BUCKET).alias("home"),
        F.when(F.col(key) == F.col("_start"), F.col("_cut")).otherwise(F.lit(0)).alias("from"),
        F.lit(None).cast("long").alias("to"),
        F.when(F.col(key) == F.col("_start"), F.col("_base")).alias("base"),
    )
    back = F.struct(
        F.col("_prev_home").alias("home"),
        F.lit(0).cast("long").alias("from"),
        F.when(F.col(key) == F.col("_start"), F.col("_cut")).alias("to"),
        F.lit(None).cast("long").alias("base"),
    )
    parts = (
        F.when(F.col("_start").isNull() | (F.col(key) < F.col("_start")), F.array(back))
        .when((F.col(key) > F.col("_start")) | (F.col("_cut") == 0), F.array(own))
        .otherwise(F.array(back, own))
    )
    return joined.select(*df.columns, F.explode(parts).alias("_p")).select(
        *df.columns,
        F.col("_p.home").alias(HOME),
        F.col("_p.from").alias("_from"),
        F.col("_p.to").alias("_to"),
        F.col("_p.base").alias("_base"),
    )


def pack_blocks(
    df: DataFrame,
    tokens: Column,
    key: str = "seq",
    block_size: int = 512,
    num_special: int = 2,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """``block_id, tokens`` with ``block_size - num_special`` tokens each.

    ``tokens`` is an expression over the columns of ``df``; it is evaluated to
    count and again behind the shuffle, so that the texts travel as they are
    stored. Texts of at most ``SHORT`` tokens are joined to longer ones first.
    """
    size = block_size - num_special
    if size <= 0:
        raise ValueError("block size must be positive")
    df, tokens, key = _joined(df, tokens, key)
    placed = place_texts(df, key, F.size(tokens), size, rows_per_bucket, max_buckets)
    local = Window.partitionBy(HOME).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    until = F.coalesce("_to", F.size("_all").cast("long"))
    # Sorted as the window wants it while the rows still hold the texts.
    cut = (
        placed.repartition(HOME)
        .sortWithinPartitions(HOME, key)
        .withColumn("_all", tokens)
        .withColumn("_len", until - F.col("_from"))
        .withColumn(
            "_t", F.slice("_all", (F.col("_from") + 1).cast("int"), F.col("_len").cast("int"))
        )
        .select(HOME, key, "_base", "_len", "_t")
    )
    laid = (
        cut.withColumn("_pos", F.sum("_len").over(local) - F.col("_len"))
        .withColumn("_base", F.first("_base").over(local))
        .where(F.col("_len") > 0)
        .select(HOME, "_base", "_pos", "_t")
    )
    pieces = laid.select(
        HOME,
        "_base",
        "_pos",
        "_t",
        F.explode(
            F.expr(f"sequence(_pos div {size}, (_pos + size(_t) - 1) div {size})")
        ).alias("_k"),
    )
    begin = F.greatest(F.col("_k") * size - F.col("_pos"), F.lit(0))
    end = F.least((F.col("_k") + 1) * size - F.col("_pos"), F.size("_t"))
    piece = F.slice("_t", (begin + 1).cast("int"), (end - begin).cast("int"))
    return (
        pieces.select(
            HOME, (F.col("_base") + F.col("_k")).alias("block_id"), "_pos", piece.alias("_piece")
        )
        .groupBy(HOME, "block_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("_pos", "_piece"))).alias("_pieces"),
            F.sum(F.size("_piece")).alias("_filled"),
        )
        .where(F.col("_filled") == size)
        .select("block_id", F.flatten(F.transform("_pieces", lambda p: p["_piece"])).alias("tokens"))
    )
