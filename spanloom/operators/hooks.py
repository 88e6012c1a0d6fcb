"""Where user code plugs in: row functions, predicates, models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.binding import once
from spanloom.functions.score import alias_match, clean_output
from spanloom.functions.spans import extract_span
from spanloom.functions.text import bare_word, normalize_answer, split_normalized, word_tokens
from spanloom.session import bound_batches


def map_rows(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """User function over Arrow batches. A row index, if needed, comes in as a
    column (``order.row_index``)."""

    bound_batches(df.sparkSession)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield fn(part)

    return df.mapInPandas(batches, schema)


def filter_rows(df: DataFrame, keep: Callable[[pd.Series], pd.Series] | Column, *columns: str) -> DataFrame:
    """Rows for which an expression, or a function over ``columns``, is true."""
    if isinstance(keep, Column):
        return df.where(keep)
    bound_batches(df.sparkSession)

    @F.pandas_udf(T.BooleanType())
    def test(*series: pd.Series) -> pd.Series:
        return keep(*series)

    return df.where(test(*columns))


def score_spans(
    df: DataFrame, make_model: Callable, *inputs: str, batch_size: int = 32, shapes=None
) -> DataFrame:
    """Start and end scores from a user's model, loaded once per Python worker.

    ``make_model()`` returns a function from numpy batches of the input columns
    to ``{"start_scores": 2-d, "end_scores": 2-d}``.
    """
    score = predict_batch_udf(
        make_model,
        return_type=T.StructType(
            [
                T.StructField("start_scores", T.ArrayType(T.FloatType())),
                T.StructField("end_scores", T.ArrayType(T.FloatType())),
            ]
        ),
        batch_size=batch_size,
        input_tensor_shapes=shapes,
    )
    return df.withColumn("_s", score(*inputs)).select("*", "_s.*").drop("_s")


def overlap_scores(df: DataFrame, question: str = "question", tokens: str = "tokens") -> DataFrame:
    """Scores without a model: 1 for a context word that the question has too.

    Words are compared in lower case without punctuation; articles never count.
    Both ends get the same score.
    """
    asked = F.array_distinct(split_normalized(normalize_answer(question)))
    hits = F.transform(
        tokens, lambda t: F.array_contains(F.col("_asked"), bare_word(t)).cast("float")
    )
    scored = once(once(df, _asked=asked), start_scores=hits)
    return scored.withColumn("end_scores", F.col("start_scores")).drop("_asked")


def evaluate_rows(
    df: DataFrame,
    score: Callable[[DataFrame], DataFrame] = overlap_scores,
    context: str = "context",
) -> DataFrame:
    """Scores each row, extracts the answer and adds ``output`` and ``match``.

    Like a sub-word decoder the extracted text starts with a space, which the
    clean-up removes.
    """
    scored = score(once(df, tokens=word_tokens(context)))
    decoded = F.concat(F.lit(" "), extract_span("tokens", "start_scores", "end_scores"))
    return once(scored, output=clean_output(decoded)).withColumn(
        "match", alias_match("output", "targets", "norm_target")
    )
