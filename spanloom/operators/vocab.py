"""Vocabulary: building one, turning tokens into ids and back."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.batches import KeyTable, decode_chunks, dictionary_chunks, lookup
from spanloom.functions.spans import SPECIAL_TOKENS, UNK
from spanloom.session import BROADCAST_ROWS, bound_batches, broadcast_if_small, cut_lineage

# Keys that a frequent token is spread over when the vocabulary is too large to broadcast;
# frequent is what holds more than one in so many tokens.
SALTS = 32
FREQUENT = 4096
# Of a vocabulary too large to broadcast, the tokens with ids below are sent all the same:
# ids follow falling counts, so few tokens of a corpus are left to be joined.
HEAD_ROWS = 1 << 20
# Elements of the arrays that share a dictionary when the vocabulary is joined.
CHUNK_TOKENS = 1 << 18
# Distinct tokens that are counted together where they are.
SEGMENT_TOKENS = 1 << 19


def build_vocab(df: DataFrame, tokens: Column, size: int | None = None) -> DataFrame:
    """``token, token_id, n``: the ``size`` most frequent tokens, ties by text; all without ``size``.

    Special tokens come first with ids 0, 1, ...; ``size`` counts without them.
    Without ``size`` all tokens are counted, combined on the map side. With it only tokens
    that may belong to the list are shuffled, see ``frequent_counts``, and the count that
    still makes it into the list is read from the histogram of counts, so only about
    ``size`` tokens are sorted.
    """
    if size is not None and size <= 0:
        raise ValueError("size must be positive")
    specials = df.sparkSession.createDataFrame(
        [(t, i, 0) for i, t in enumerate(SPECIAL_TOKENS)], "token string, token_id long, n long"
    )
    if size is None:
        counts = cut_lineage(
            df.select(F.explode(tokens).alias("token"))
            .groupBy("token")
            .agg(F.count(F.lit(1)).alias("n"))
            .where(~F.col("token").isin(SPECIAL_TOKENS))
        )
        return specials.unionByName(_numbered(counts))
    counts = cut_lineage(frequent_counts(df, tokens, size))
    enough = _reached(counts, size)
    top = counts if enough is None else counts.where(F.col("n") >= enough)
    top = top.orderBy(F.desc("n"), "token").limit(size)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token"))
    ranked = top.select(
        "token", (rank.cast("long") - 1 + len(SPECIAL_TOKENS)).alias("token_id"), "n"
    )
    return specials.unionByName(ranked)


def _reached(counts: DataFrame, rows: int) -> int | None:
    """The highest ``n`` that at least so many rows have or exceed; None if there are fewer rows."""
    histogram = counts.groupBy("n").agg(F.count(F.lit(1)).alias("with_n"))
    at_least = F.sum("with_n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n")))
    return histogram.withColumn("cum", at_least).where(F.col("cum") >= rows).agg(F.max("n")).first()[0]


def _segment_counts(batches):
    """Counts of the distinct tokens of a partition, in segments of bounded size."""
    from pyspark import TaskContext

    segment, held = TaskContext.get().partitionId() << 32, None

    def rows():
        return [
            pa.RecordBatch.from_arrays(
                [pa.array(np.full(b.num_rows, segment), pa.int64()), b.column("token"), b.column("n")], names=["segment", "token", "n"]
            )
            for b in held.to_batches(max_chunksize=65_536)
        ]

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            found = batch.column("tokens").slice(at, 512).flatten().drop_null().value_counts()
            part = pa.table({"token": found.field("values").cast(pa.string()), "n": found.field("counts").cast(pa.int64())})
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows > 2 * SEGMENT_TOKENS:
                held = _added(held)
                if held.num_rows > SEGMENT_TOKENS:
                    yield from rows()
                    segment, held = segment + 1, None
    if held is not None:
        held = _added(held)
        yield from rows()


def _added(counts: pa.Table) -> pa.Table:
    found = counts.group_by("token").aggregate([("n", "sum")])
    return pa.table({"token": found["token"], "n": found["n_sum"]})


def frequent_counts(df: DataFrame, tokens: Column, size: int) -> DataFrame:
    """``token, n``: exact counts of the ``size`` most frequent tokens, ties included, and of some more.

    Each segment of the table is counted where it is. The highest local counts, added up,
    are a lower bound of what the last token of the list has; a token that reaches this bound
    has its share of it in one segment at least. The others are pruned before anything but
    the highest local counts is shuffled, and the tokens left are counted over all segments.
    """
    bound_batches(df.sparkSession)
    arrays = df.select(tokens.alias("tokens"))
    local = cut_lineage(arrays.mapInArrow(_segment_counts, "segment long, token string, n long"))
    local = local.where(~F.col("token").isin(SPECIAL_TOKENS))
    total = F.sum("n").alias("n")
    high = _reached(local, 8 * size) or 1
    bound = _reached(local.where(F.col("n") >= high).groupBy("token").agg(total), size) or 1
    segments = local.agg(F.count_distinct("segment")).first()[0]
    if bound <= segments:  # any token may belong to the list
        return local.groupBy("token").agg(total)
    hopeful = local.where(F.col("n") * segments >= bound).select("token").distinct()
    side, _ = broadcast_if_small(cut_lineage(hopeful))
    return local.join(side, "token", "left_semi").groupBy("token").agg(total)


def _numbered(counts: DataFrame) -> DataFrame:
    """Ids of all tokens by falling count, ties by text, without a window over the table.

    The table is sorted over all partitions; only their sizes are ordered as a whole.
    """
    ordered = cut_lineage(
        counts.repartitionByRange(F.desc("n"), "token")
        .sortWithinPartitions(F.desc("n"), "token")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    w = Window.orderBy("_p")
    parts = (
        ordered.groupBy(F.col("_part").alias("_p"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
        .withColumn("_before", F.sum("_rows").over(w) - F.col("_rows"))
    )
    side, _ = broadcast_if_small(cut_lineage(parts))
    at = F.col("_before") + F.col("_at") - F.col("_first")
    return ordered.join(side, F.col("_part") == F.col("_p")).select(
        "token", (at + len(SPECIAL_TOKENS)).alias("token_id"), "n"
    )


def vocab_lookup(
    tokens: DataFrame,
    vocab: DataFrame,
    key: Sequence[str],
    token: str = "token",
    salts: int = SALTS,
    max_rows: int = BROADCAST_ROWS,
    unknown: int = SPECIAL_TOKENS.index(UNK),
) -> DataFrame:
    """Adds ``token_id`` to one-token-per-row data; unknown tokens get ``unknown``.

    A vocabulary measured to have at most ``max_rows`` rows is broadcast. Of a larger one the
    first ``HEAD_ROWS`` ids (``max_rows``, if that is less) are, and only tokens without one
    of them are joined by shuffle; ``tokens`` is then read several times. Tokens that hold
    a large share of these rows go by ``salts`` keys, chosen by the unique row ``key``,
    so that none ends in one task; the vocabulary's other rows are shuffled once.
    """
    ids = vocab.select(F.col("token").alias("_v"), "token_id")
    side, small = broadcast_if_small(ids, max_rows)
    if small:
        joined = tokens.join(side, F.col(token) == F.col("_v"), "left")
    else:
        head, ids = _head(ids, max_rows)
        rest = tokens
        if head is not None:
            head = F.broadcast(head)
            rest = tokens.join(head, F.col(token) == F.col("_v"), "left_anti")
        seen = rest.groupBy(F.col(token).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
        seen = cut_lineage(seen.where(F.col("_h").isNotNull()))
        total = seen.agg(F.sum("_n")).first()[0] or 0
        # fewer than FREQUENT tokens
        often = cut_lineage(seen.where(F.col("_n") * FREQUENT > total).where("_n > 1").select("_h"))
        copies = ids.join(F.broadcast(often), F.col("_v") == F.col("_h"), "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_h").isNotNull(), salts - 1).otherwise(0)))
        ).drop("_h")
        salt = F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int")
        salted = rest.join(F.broadcast(often), F.col(token) == F.col("_h"), "left").withColumn(
            "_r", F.when(F.col("_h").isNotNull() | F.col(token).isNull(), salt).otherwise(0)
        ).drop("_h")
        joined = salted.join(
            copies, (F.col(token) == F.col("_v")) & (F.col("_r") == F.col("_salt")), "left"
        ).drop("_r", "_salt")
        if head is not None:
            joined = tokens.join(head, F.col(token) == F.col("_v")).unionByName(joined)
    return joined.withColumn(
        "token_id", F.coalesce("token_id", F.lit(unknown).cast("long"))
    ).drop("_v")


def _head(table: DataFrame, max_rows: int) -> tuple[DataFrame | None, DataFrame]:
    """The rows of the lowest ids, if they are measured small, and the others."""
    ids, rows = F.col("token_id"), min(max_rows, HEAD_ROWS)
    if rows <= 0:
        return None, table
    low = (ids >= 0) & (ids < rows)
    head = table.where(low)
    if not broadcast_if_small(head, rows)[1]:
        return None, table
    return head, table.where(~F.coalesce(low, F.lit(False)))


def _exchange(
    df: DataFrame, column: str, out: str, table: DataFrame, missing, max_rows: int
) -> DataFrame:
    """``df`` with ``out``: the elements of ``column`` replaced through a two-column table."""
    source, target = table.columns
    result = table.schema[target].dataType
    _, small = broadcast_if_small(table, max_rows)
    if small:
        return df.withColumn(out, lookup(F.col(column), _key_table(table), missing, result))

    head, table = _head(table, max_rows)
    known = None if head is None else _key_table(head)
    kept = [f for f in df.schema if f.name != out]
    rows = df.select(F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row"), F.col(f"`{column}`").alias("_of"))
    words = T.StructField("words", df.schema[column].dataType)
    schema = T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("row", T.StructType(kept)), T.StructField("codes", T.ArrayType(T.IntegerType())), words]
    )
    bound_batches(df.sparkSession)
    coded = cut_lineage(rows.mapInArrow(dictionary_chunks("_of", CHUNK_TOKENS, known), schema))
    # a token stands once for each chunk at most, so none has many rows
    distinct = coded.where("words is not null").select("chunk", F.posexplode("words").alias("pos", "_x"))
    found = distinct.join(table.select(F.col(source).alias("_from"), F.col(target).alias("to")), F.col("_x") == F.col("_from"), "left")
    after = T.StructType([*kept, T.StructField(out, T.ArrayType(result))])
    return (
        coded.select("chunk", "row", "codes")
        .groupBy("chunk")
        .cogroup(found.select(F.col("chunk").alias("of"), "pos", "to").groupBy("of"))
        .applyInArrow(decode_chunks(out, [f.name for f in kept], missing, known), after)
    )


def _key_table(table: DataFrame) -> Broadcast:
    """A two-column table as a ``KeyTable`` that the workers look up in."""
    pairs = table.toArrow().combine_chunks()
    keys, values = (pa.concat_arrays(pairs[c].chunks) if pairs[c].num_chunks else pa.array([], pairs.schema.field(c).type) for c in table.columns)
    return table.sparkSession.sparkContext.broadcast(KeyTable(keys, values))


def tokens_to_ids(
    df: DataFrame,
    tokens: str,
    vocab: DataFrame,
    key: str | None = None,
    out: str = "ids",
    max_rows: int = BROADCAST_ROWS,
    unknown: int = SPECIAL_TOKENS.index(UNK),
) -> DataFrame:
    """Adds (or replaces) ``out``: the ids of a token array, ``unknown`` for unknown ones.

    A vocabulary measured small is sent to the executors and looked up in Arrow
    batches, without a shuffle. Beyond that this is done for the first ``HEAD_ROWS`` ids, and
    rows are coded in chunks; only a chunk's distinct other tokens are joined, and its rows,
    shuffled once, meet their ids. With ``out`` named like ``tokens`` the tokens themselves
    are not shuffled along. Rows may repeat; NULL arrays stay NULL, and NULL elements are
    unknown. The order of the columns is that of ``df``, ``out`` last.
    """
    return _exchange(df, tokens, out, vocab.select("token", "token_id"), unknown, max_rows)


def ids_to_tokens(
    df: DataFrame,
    ids: str,
    vocab: DataFrame,
    key: str | None = None,
    out: str = "tokens",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The way back; ids not in the vocabulary give ``<unk>``."""
    return _exchange(df, ids, out, vocab.select("token_id", "token"), UNK, max_rows)
