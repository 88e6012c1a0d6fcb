"""Row-wise operators of the QA jobs; they work on streams as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of a prepared row, and the character budget of a pair.
FEATURE_COLUMNS = ["input_ids", "attention_mask", "start_positions", "end_positions"]
LENGTH_BUDGET = 4 * 4096


def format_trivia(df: DataFrame) -> DataFrame:
    """Flattens a long-document QA row: ``context``, ``targets``, ``norm_target``.

    Line ends in the pages become spaces; spaces are not collapsed.
    """
    pages = F.array_join(F.col("entity_pages.wiki_context"), "\n")
    return (
        df.withColumn("context", F.replace(pages, F.lit("\n"), F.lit(" ")))
        .withColumn("targets", F.col("answer.aliases"))
        .withColumn("norm_target", F.col("answer.normalized_value"))
        .drop("search_results", "question_source", "entity_pages", "answer", "question_id")
    )


def filter_nonempty(df: DataFrame, text: str = "context") -> DataFrame:
    return df.where(F.length(text) > 0)


def filter_length_budget(
    df: DataFrame,
    question: str = "question",
    context: str = "context",
    budget: int = LENGTH_BUDGET,
) -> DataFrame:
    """Keeps pairs with fewer than ``budget`` characters."""
    return df.where(F.length(question) + F.length(context) < budget)


def filter_valid_spans(df: DataFrame) -> DataFrame:
    return df.where(F.col("start_positions").isNotNull() & F.col("end_positions").isNotNull())


def feature_view(df: DataFrame, *keep: str) -> DataFrame:
    """The columns a model reads; ``keep`` adds identifying ones."""
    return df.select(*keep, *FEATURE_COLUMNS)
