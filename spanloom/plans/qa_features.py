"""From QA rows to model features, and from predictions to scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.binding import once
from spanloom.functions.spans import (
    align_answer,
    align_answer_ci,
    encode_pair,
    extract_span,
    span_policy,
    span_to_tokens,
    span_to_tokens_first,
)
from spanloom.functions.text import span_offsets, word_tokens
from spanloom.operators.concat import concat_contexts, concat_groups
from spanloom.operators.evaluate import score_answers, squad_eval_by
from spanloom.operators.hooks import overlap_scores
from spanloom.operators.profile import row_audit
from spanloom.operators.rows import filter_valid_spans
from spanloom.operators.vocab import tokens_to_ids
from spanloom.session import broadcast_if_small, cut_lineage
from spanloom.sources import registry
from spanloom.sources.registry import label_languages


def label_spans(
    df: DataFrame,
    max_length: int = 512,
    policy: str | Sequence[str] = "null",
    limit: int | None = None,
    tokenize: Callable[[Column], Column] | None = None,
    context_first: bool = False,
    fold_case: bool = False,
    context_tokens: str | None = None,
) -> DataFrame:
    """Adds ``span`` (repaired offsets), ``encoded`` and the token positions.

    Expects ``question, context, answers<text[], answer_start[]>``. Every row
    stays; rejected ones have NULL positions. ``limit`` is that of ``span_policy`` and
    follows ``max_length``. ``tokenize`` is a column function to
    ``array<struct<tok,start,end>>``, see ``batch_tokenizer``; words by default.
    ``fold_case`` compares answers with the lower-cased context. ``context_tokens``
    names a column with the words of the context where they have been made before. With
    several policies the rows are labelled once, and each policy's positions are called
    ``<policy>_start_positions`` and ``<policy>_end_positions``.

    Under the policy ``null`` a position may lie behind the encoded input; such rows
    are counted as ``over_long`` by ``rejection_reason``, and ``prepare_features`` leaves
    them out where asked.
    """
    gold = F.get("answers.text", 0)
    start = F.get("answers.answer_start", 0)
    align = align_answer_ci if fold_case else align_answer
    made = {"span": align(F.col("context"), gold, start)}
    if tokenize is None:
        made["_q"] = word_tokens("question")
        made["_c"] = word_tokens("context") if context_tokens is None else F.col(context_tokens)
    else:
        made["_qt"], made["_ct"] = tokenize(F.col("question")), tokenize(F.col("context"))
    split = once(df, **made)
    at = None
    if tokenize is not None:
        split = split.withColumns({"_q": F.col("_qt.tok"), "_c": F.col("_ct.tok")})
        at = span_offsets(F.col("_ct"), F.col("span.start"), F.col("span.end"))
    sides = (F.col("_c"), F.col("_q")) if context_first else (F.col("_q"), F.col("_c"))
    encoded = once(split, encoded=encode_pair(*sides, max_length))
    if context_first:
        place = span_to_tokens_first(
            F.col("context"), F.col("span"), F.col("encoded.kept_first"), at
        )
    else:
        place = span_to_tokens(F.col("context"), F.col("span"), F.col("encoded.input"), at=at)
    placed = once(encoded, _at=place)
    top = max_length if limit is None else limit
    positions = ("start_positions", "end_positions")
    names = {policy: positions} if isinstance(policy, str) else {p: [f"{p}_{x}" for x in positions] for p in policy}
    found = [
        span_policy(F.col("_at.start"), F.col("_at.end"), p, top)[x].alias(y)
        for p, called in names.items()
        for x, y in zip(positions, called)
    ]
    return placed.select(*df.columns, "span", "encoded", *found)


def rejection_reason(max_length: int):
    """Why a labelled row would be dropped or is of no use; NULL if it is fine."""
    return (
        F.when(F.col("span").isNull(), F.lit("unaligned"))
        .when(F.col("start_positions").isNull() | F.col("end_positions").isNull(), F.lit("unmapped"))
        .when(F.col("end_positions") >= max_length, F.lit("over_long"))
    )


def audit_preparation(
    qa: DataFrame,
    nr_concats: int | None = None,
    max_length: int = 512,
    policy: str = "null",
    limit: int | None = None,
    by: tuple[str, ...] = ("lang",),
) -> DataFrame:
    """``reason, n_rows`` per ``by``: rows that stay, and rows lost at each step.

    ``repeated`` counts rows dropped as repeats of their neighbour's context.
    """
    rows = concat_contexts(qa, nr_concats, by=by) if nr_concats is not None else qa
    # The counts are a few rows per language and are used twice.
    after = cut_lineage(
        row_audit(label_spans(rows, max_length, policy, limit), rejection_reason(max_length), by)
    )
    left = after.groupBy(*by).agg(F.sum("n_rows").alias("_left"))
    repeated = (
        qa.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_all"))
        .join(left, list(by), "left")
        .select(
            *by,
            F.lit("repeated").alias("reason"),
            (F.col("_all") - F.coalesce("_left", F.lit(0))).alias("n_rows"),
        )
    )
    return after.unionByName(repeated)


def prepare_features(
    qa: DataFrame,
    vocab: DataFrame | None = None,
    nr_concats: int | None = None,
    max_length: int = 512,
    policy: str = "null",
    limit: int | None = None,
    by: tuple[str, ...] = ("lang",),
    over_long: bool = True,
    **options,
) -> DataFrame:
    """Training rows: concatenation (opt-in), offset repair, encoding, labels.

    Without a vocabulary ``input_ids`` holds the tokens themselves. A joined context
    is tokenised once per group. ``over_long`` keeps rows whose answer lies behind the
    encoded input (only the policy ``null`` has them), as labels that no input holds.
    Takes the further options of ``label_spans``.
    """
    if nr_concats is not None:
        groups = concat_groups(qa, nr_concats, by=by)
        if options.get("tokenize") is None:
            groups = once(groups, _words=word_tokens("context"))
            options["context_tokens"] = "_words"
        rest = [c for c in groups.columns if c != "members"]
        qa = groups.select(*rest, F.explode("members").alias("_m")).select(*rest, "_m.*")
    labelled = filter_valid_spans(label_spans(qa, max_length, policy, limit, **options))
    if not over_long:
        labelled = labelled.where(F.col("end_positions") <= max_length)
    rows = labelled.select(
        "seq",
        *by,
        F.col("encoded.input").alias("input_ids"),
        F.col("encoded.attention_mask").alias("attention_mask"),
        "start_positions",
        "end_positions",
    )
    if vocab is None:
        return rows
    return tokens_to_ids(rows, "input_ids", vocab, out="input_ids", key="seq")


def evaluate_predictions(
    references: DataFrame,
    predictions: DataFrame,
    key: str = "seq",
    by: str | Sequence[str] = "lang",
) -> DataFrame:
    """Exact match and F1 per ``by`` and overall, over the paired rows."""
    names = [by] if isinstance(by, str) else list(by)
    pairs = references.select(key, *names, "golds").join(predictions.select(key, "pred"), key)
    return squad_eval_by(score_answers(pairs), by)


def evaluate_model(
    rows: DataFrame,
    base: str | Sequence[str],
    score: Callable[[DataFrame], DataFrame] = overlap_scores,
    key: str = "seq",
    languages: DataFrame | None = None,
    dataset: str | None = None,
) -> DataFrame:
    """``lang, exact_match, f1, n, n_unscored, label``: from a model's scores to labelled results.

    ``rows`` have ``question, context, golds, lang``. ``score`` adds start and end scores
    over ``tokens``; where it leaves ``golds`` in place answers are scored in the same row,
    else they are paired by key. With the name of a ``dataset`` column, the results are per
    (dataset, language) with overall lines, for the corpora named by ``base``, in one pass.
    """
    names = ["lang"] if dataset is None else [dataset, "lang"]
    scored = score(once(rows, tokens=word_tokens("context")))
    pred = extract_span("tokens", "start_scores", "end_scores").alias("pred")
    if {"golds", *names} <= set(scored.columns):
        results = squad_eval_by(score_answers(scored.select(key, *names, "golds", pred)), names)
    else:
        results = evaluate_predictions(rows, scored.select(key, pred), key, names)
    if dataset is None:
        dim = registry.languages(rows.sparkSession, base) if languages is None else languages
        return label_languages(results, dim)
    if languages is None:
        known = [registry.languages(rows.sparkSession, b).withColumn(dataset, F.lit(b)) for b in ([base] if isinstance(base, str) else base)]
        languages = reduce(DataFrame.unionByName, known)
    side, _ = broadcast_if_small(languages)
    return results.join(side, names, "left")


def report_of(results: DataFrame) -> DataFrame:
    """``metric, value`` lines named ``<language>_<measure>``, for ``store.write_report``."""
    pairs = [
        F.struct(F.concat_ws("_", "lang", F.lit(m)).alias("metric"), F.col(m).alias("value"))
        for m in ("exact_match", "f1")
    ]
    return results.select(F.inline(F.array(*pairs)))
