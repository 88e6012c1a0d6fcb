"""Long-document question answering: select, score, count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.masking import seeded_key
from spanloom.operators.batches import make_batches
from spanloom.operators.evaluate import alias_accuracy
from spanloom.operators.hooks import evaluate_rows, overlap_scores
from spanloom.operators.order import split_percent
from spanloom.operators.rows import (
    LENGTH_BUDGET,
    filter_length_budget,
    filter_nonempty,
    format_trivia,
)
from spanloom.plans.qa_features import label_spans
from spanloom.session import cut_lineage


def select_documents(
    raw: DataFrame, key: str, percent: float | None = None, budget: int | None = None
) -> DataFrame:
    """Leading share of the rows, flattened, without empty ones.

    ``budget`` also leaves out rows whose question and context are longer together;
    ``LENGTH_BUDGET`` is that of 4,096 tokens. ``over_budget`` counts such rows.
    """
    if percent is not None:
        raw = split_percent(raw, key, percent)
    rows = filter_nonempty(format_trivia(raw))
    return rows if budget is None else filter_length_budget(rows, budget=budget)


def training_batches(
    qa: DataFrame,
    max_length: int,
    batch_size: int,
    seed: int,
    key: str = "seq",
    policy: str = "fill_max",
    tokenize: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Batches for training on long documents, in a reproducible shuffled order.

    Answers are repaired against the lower-cased context, the context comes first,
    and an answer that was cut away gets the policy's position. Each batch has the
    rows' keys, ``input_ids``, ``attention_mask`` and positions as arrays.
    """
    labelled = label_spans(
        qa, max_length, policy, tokenize=tokenize, context_first=True, fold_case=True
    )
    rows = labelled.select(
        key,
        F.col("encoded.input").alias("input_ids"),
        F.col("encoded.attention_mask").alias("attention_mask"),
        "start_positions",
        "end_positions",
    )
    # Ordering reads its input several times; the rows should be made once. The seeded order
    # and the batches are one ordering run.
    drawn = cut_lineage(rows.withColumn("_draw", seeded_key(seed, F.col(key))))
    columns = [key, "input_ids", "attention_mask", "start_positions", "end_positions"]
    return make_batches(drawn, batch_size, columns, ["_draw", key])


def over_budget(documents: DataFrame, budget: int = LENGTH_BUDGET) -> DataFrame:
    """``n_total`` rows, and ``n_over`` of them that the length budget would leave out."""
    length = F.length("question") + F.length("context")
    return documents.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(length >= budget).alias("n_over")
    )


def accuracy(
    documents: DataFrame, score: Callable[[DataFrame], DataFrame] = overlap_scores
) -> DataFrame:
    return alias_accuracy(evaluate_rows(documents, score))
