"""The corpus pipeline: stages over ``documents``, each written and read again by the next.

All stages take any further columns along. An empty table stays empty in all of them,
texts are read whole, and a NULL text counts as empty; it stays NULL where a stage
returns it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import bpe, decontaminate, near_copies, pii, quality_rules
from spanloom.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    NULL, empty and short texts go, as they have fewer than 50 words; repeated rows are
    judged alike and stay as often as they stand there.
    """
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (5-word Jaccard of 0.8 or more) stays, that with the smallest id.

    NULL and empty texts are copies of one another. Of rows that share the id that with
    the smallest hash of its text stays, repeated rows once; an id that is NULL stays only
    where its class has no other.
    """
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Items of fewer than ten words are one window; items and documents without words match
    nothing. Repeated rows go or stay together.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind.

    ``n_chars`` follows the new text; NULL texts stay NULL and no row goes.
    """
    return pii.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, their token ids ``ids``, and ``n_tokens``, the number of ids.

    NULL and empty texts have no ids. Columns of these two names, in any case, are replaced.
    """
    found = bpe.encode(docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "n_tokens")]))
    return found.selectExpr("row.*", "ids", "cast(size(ids) as long) as n_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: The stages hash, segment and tokenise in ways SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every intermediate result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for step, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{step}")
        docs = spark.read.parquet(f"{folder}/{step}")
    return docs
