"""Scoring functions on prediction and gold columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.binding import let
from spanloom.functions.text import _col, normalize_answer, split_normalized


def _numbered(tokens: Column) -> Column:
    """Each token with the number of its repeat, so that bags become sets.

    Runs of equal tokens in sorted order are numbered from where they start, so the
    cost is that of sorting.
    """

    def number(ordered: Column) -> Column:
        n = F.size(ordered)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.array().cast("array<int>"))
        begins = F.filter(at, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

        def run(starts: Column, s: Column, k: Column) -> Column:
            until = F.coalesce(F.get(starts, k + 1), n) - 1
            return F.transform(
                F.sequence(s, until),
                lambda j: F.concat_ws(" ", F.get(ordered, s), (j - s).cast("string")),
            )

        return let(
            begins, lambda starts: F.flatten(F.transform(starts, lambda s, k: run(starts, s, k)))
        )

    return let(F.array_sort(tokens), number)


def shared_tokens(left: Column, right: Column) -> Column:
    """Size of the bag intersection of two token arrays."""
    return F.size(F.array_intersect(_numbered(left), _numbered(right)))


def _f1(shared: Column, n_pred: Column, n_gold: Column) -> Column:
    return let(shared, lambda s: f1_from_counts(s, n_pred, n_gold))


def f1_from_counts(shared: Column, n_pred: Column, n_gold: Column) -> Column:
    """Harmonic mean of precision and recall; 0 when nothing is shared."""
    precision = shared / n_pred
    recall = shared / n_gold
    return F.when(shared == 0, F.lit(0.0)).otherwise(
        (2 * precision * recall) / (precision + recall)
    )


def token_f1(pred: str | Column, gold: str | Column) -> Column:
    """Token F1 of two answers. Documents can also be counted token by token, see
    ``operators.evaluate.token_f1_long``."""
    return let(
        split_normalized(normalize_answer(pred)),
        lambda p: let(
            split_normalized(normalize_answer(gold)),
            lambda g: _f1(shared_tokens(p, g), F.size(p), F.size(g)),
        ),
    )


def exact_match(pred: str | Column, gold: str | Column) -> Column:
    """Equality after normalisation; two empty answers match."""
    return normalize_answer(pred) == normalize_answer(gold)


def best_exact_match(pred_norm: Column, golds_norm: Column) -> Column:
    """1 if any gold equals the prediction; NULL without golds. Inputs normalised."""
    return F.array_max(F.transform(golds_norm, lambda g: (g == pred_norm).cast("int")))


def best_f1(pred_norm: Column, golds_norm: Column) -> Column:
    """Best token F1 over the golds; NULL without golds. Inputs normalised."""

    def per_gold(pred_bag: Column) -> Column:
        return F.transform(
            golds_norm,
            lambda gold: let(
                split_normalized(gold),
                lambda g: _f1(
                    F.size(F.array_intersect(pred_bag, _numbered(g))), F.size(pred_bag), F.size(g)
                ),
            ),
        )

    return F.array_max(let(_numbered(split_normalized(pred_norm)), per_gold))


def clean_output(text: str | Column) -> Column:
    """Drops the first character (the decoder's leading space) and double quotes."""
    return F.replace(F.substring(_col(text), F.lit(2), F.length(_col(text))), F.lit('"'), F.lit(""))


def alias_match(output: str | Column, targets: str | Column, norm_target: str | Column) -> Column:
    """Whether the output is one of the targets or the normalised target, as is."""
    output = _col(output)
    return F.coalesce(F.array_contains(_col(targets), output), F.lit(False)) | F.coalesce(
        output == _col(norm_target), F.lit(False)
    )
