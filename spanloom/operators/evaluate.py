"""Pairing predictions with gold answers and scoring them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.binding import once
from spanloom.functions.score import (
    best_exact_match,
    best_f1,
    f1_from_counts,
)
from spanloom.functions.spans import argmax
from spanloom.functions.text import answer_tokens, normalize_answer, split_normalized


def align_predictions(references: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Pairs by key, with ``state``: ``paired``, ``no prediction`` or ``no reference``.

    One full join, so both kinds of leftovers come out of the same shuffle. Only
    paired rows are to be scored.
    """
    left = references.withColumn("_r", F.lit(True))
    right = predictions.withColumn("_p", F.lit(True))
    return (
        left.join(right, key, "full")
        .withColumn(
            "state",
            F.when(F.col("_p").isNull(), "no prediction")
            .when(F.col("_r").isNull(), "no reference")
            .otherwise("paired"),
        )
        .drop("_r", "_p")
    )


def score_answers(df: DataFrame, pred: str = "pred", golds: str = "golds") -> DataFrame:
    """Adds ``em`` (0/1) and ``f1``, each the best over the row's golds.

    Rows without golds get NULL. The cost grows in proportion to the texts.
    """
    norm = once(
        df, _p=normalize_answer(pred), _g=F.transform(golds, lambda g: normalize_answer(g))
    )
    return norm.select(
        *df.columns,
        best_exact_match(F.col("_p"), F.col("_g")).alias("em"),
        best_f1(F.col("_p"), F.col("_g")).alias("f1"),
    )


def token_f1_long(df: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """``key, n_pred, n_gold, shared, f1`` for long texts, one pair per unique key.

    Both texts become (key, token, count, count) rows, so counting is combined
    on the map side and no text meets another whole.
    """
    sides = df.select(
        key,
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("side"))),
                F.transform(answer_tokens(pred), lambda t: F.struct(t.alias("t"), F.lit(1).alias("side"))),
                F.transform(answer_tokens(gold), lambda t: F.struct(t.alias("t"), F.lit(2).alias("side"))),
            )
        ).alias("_x"),
    )
    per_token = sides.groupBy(key, F.col("_x.t").alias("_t")).agg(
        F.count_if(F.col("_x.side") == 1).alias("_np"),
        F.count_if(F.col("_x.side") == 2).alias("_ng"),
    )
    return (
        per_token.groupBy(key)
        .agg(
            F.sum("_np").alias("n_pred"),
            F.sum("_ng").alias("n_gold"),
            F.sum(F.least("_np", "_ng")).alias("shared"),
        )
        .withColumn("f1", f1_from_counts(F.col("shared"), F.col("n_pred"), F.col("n_gold")))
    )


def _sums(by: Sequence[str], scored: DataFrame) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.sum("em").alias("_em"),
        F.sum("f1").alias("_f1"),
        F.count("em").alias("n"),
        F.count_if(F.col("em").isNull()).alias("n_unscored"),
    )


def _means(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    return sums.select(
        *by,
        F.try_divide(100.0 * F.col("_em"), F.col("n")).alias("exact_match"),
        F.try_divide(100.0 * F.col("_f1"), F.col("n")).alias("f1"),
        "n",
        "n_unscored",
    )


def squad_eval(scored: DataFrame) -> DataFrame:
    """Percent exact match and F1 over all scored rows; NULL without rows."""
    return _means(_sums([], scored), [])


def squad_eval_by(
    scored: DataFrame, by: str | Sequence[str] = "lang", total: str = "all"
) -> DataFrame:
    """The same per ``by`` value in one pass, with an overall line named ``total``.

    The overall line is rolled up from the per-value sums. With several columns each
    but the first has a ``total`` line within the ones before it.
    """
    by = [by] if isinstance(by, str) else list(by)
    parts = _sums(by, scored)
    rolled = parts.rollup(*by).agg(
        *[F.sum(c).alias(c) for c in ("_em", "_f1", "n", "n_unscored")],
        *[F.grouping(c).alias(f"_all_{c}") for c in by],
    )
    named = {c: F.when(F.col(f"_all_{c}") == 1, F.lit(total)).otherwise(F.col(c)) for c in by}
    return _means(rolled.withColumns(named), by)


def alias_accuracy(matched: DataFrame, match: str = "match") -> DataFrame:
    """How many rows matched, of how many."""
    return matched.agg(
        F.coalesce(F.sum(F.col(match).cast("long")), F.lit(0)).alias("n_correct"),
        F.count(F.lit(1)).alias("n_total"),
    )


def wrong_answers(indexed: DataFrame, match: str = "match") -> DataFrame:
    """Rows that did not match."""
    return indexed.where(~F.col(match))


def predicted_class(logits: str | Column) -> Column:
    return argmax(logits)


def binary_metrics(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; 0 where a divisor is 0."""
    pred, truth = predicted_class(logits) == 1, F.col(label) == 1
    counts = df.agg(
        F.count_if(pred & truth).alias("tp"),
        F.count_if(pred & ~truth).alias("fp"),
        F.count_if(~pred & truth).alias("fn"),
        F.count_if(~pred & ~truth).alias("tn"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def unigram_bits(counts: DataFrame, n: str = "n") -> DataFrame:
    """Mean loss per token, and in bits, of tokens drawn by their own counts; one pass."""
    total = F.sum(n)
    loss = F.log(total) - F.sum(F.col(n) * F.log(F.col(n))) / total
    return counts.agg(loss.alias("loss")).withColumn("bits", F.col("loss") / math.log(2))


def bits_per_token(df: DataFrame, loss: str = "loss", weight: str | None = None) -> DataFrame:
    """Mean loss per token and the same in bits. ``weight`` counts equal losses."""
    if weight is None:
        mean = F.avg(loss)
    else:
        mean = F.try_divide(F.sum(F.col(loss) * F.col(weight)), F.sum(weight))
    return df.agg(mean.alias("loss")).withColumn("bits", F.col("loss") / math.log(2))
