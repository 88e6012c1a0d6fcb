"""Text functions: answer normalisation, tokens, character-to-token mapping."""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.batches import with_offsets
from spanloom.functions.binding import let
from spanloom.session import bound_batches

# ASCII punctuation, English articles as whole Unicode words, and
# the characters that separate words. `\b` and `\s` of Java differ on non-ASCII
# text, so they are spelled out.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"
WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"

# Default word tokeniser: runs of non-space.
TOKEN = r"\S+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_answer(text: str | Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(_col(text)), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, ARTICLES, " "), WHITESPACE, " "))


def bare_word(word: str | Column) -> Column:
    """Normal form of one word: lower case, no punctuation. Articles stay."""
    return F.translate(F.lower(_col(word)), string.punctuation, "")


def split_normalized(text: str | Column) -> Column:
    """Words of an already normalised text; none for the empty text."""
    return F.filter(F.split(_col(text), " "), lambda t: t != "")


def answer_tokens(text: str | Column) -> Column:
    """Words of the normalised text."""
    return split_normalized(normalize_answer(text))


def word_tokens(text: str | Column, token: str = TOKEN) -> Column:
    """Tokens of ``text`` in order, as an array."""
    return F.regexp_extract_all(_col(text), F.lit(token), F.lit(0))


def char_to_token(text: str | Column, at: str | Column, token: str = TOKEN) -> Column:
    """0-based token holding character ``at``; NULL on a gap or outside the text.

    Counts the tokens that begin up to that character, so it is linear in the
    text and needs no offset table. ``token`` must be a pattern whose matches
    stay matches when cut short (runs of a character class are).
    """
    text, at = _col(text), _col(at)
    inside = (at >= 0) & F.substring(text, at + 1, F.lit(1)).rlike(token)
    until = F.substring(text, F.lit(1), at + 1)
    return F.when(inside, F.regexp_count(until, F.lit(token)).cast("long") - 1)


def span_tokens(
    text: str | Column, start: str | Column, end: str | Column, token: str = TOKEN
) -> Column:
    """``struct<start,end>``: the tokens of a span's first and last character.

    As ``char_to_token`` for both, but the text before the span is read once.
    """
    text, start, end = _col(text), _col(start), _col(end)

    def holds(at: Column) -> Column:
        return (at >= 0) & F.substring(text, at + 1, F.lit(1)).rlike(token)

    def both(begun: Column) -> Column:
        inside = F.regexp_count(F.substring(text, start + 1, end - start), F.lit(token))
        first = F.when(holds(start), begun - 1)
        ahead = begun - holds(start).cast("int")
        last = F.when(holds(end - 1) & (end > start), ahead + inside - 1)
        last = last.when(holds(end - 1), char_to_token(text, end - 1, token))
        return F.struct(first.cast("long").alias("start"), last.cast("long").alias("end"))

    until = F.regexp_count(F.substring(text, F.lit(1), start + 1), F.lit(token))
    return let(until, both)


def tokenize_offsets(text: str | Column, token: str = TOKEN) -> Column:
    """Tokens as ``array<struct<tok,start,end>>``: character offsets, end exclusive."""
    return with_offsets(word_tokens(text, token), F.split(_col(text), token, -1))


def flat_tokenizer(
    tokenize: Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]],
) -> Callable[[Column], Column]:
    """A column function from a user's tokenizer that works on whole Arrow batches.

    ``tokenize`` takes the texts, without NULLs, and returns all tokens one behind the
    other, where each begins and ends in its text (characters, end exclusive), and where
    each text's tokens begin among them, with one more element than there are texts.
    NULL texts give NULL.
    """
    part = "array<struct<tok:string,start:long,end:long>>"
    bound_batches()

    @F.arrow_udf(part)
    def run(texts: pa.Array) -> pa.Array:
        words, start, end, first = tokenize(texts.drop_null())
        known = texts.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(texts), np.int64)
        sizes[known] = np.diff(first)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        parts = [pa.array(words, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
        rows = pa.StructArray.from_arrays(parts, ["tok", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets), rows, mask=None if known.all() else pa.array(~known))

    return run


def batch_tokenizer(tokenize: Callable[[list], list]) -> Callable[[Column], Column]:
    """A column function from a user's tokenizer, called with a batch of texts.

    ``tokenize`` takes a list of texts (None for NULL) and returns for each a list of
    ``(token, start, end)``, character offsets with the end exclusive, or None. Where speed
    matters ``flat_tokenizer`` does without a tuple per token.
    """
    part = "array<struct<tok:string,start:long,end:long>>"
    bound_batches()

    @F.arrow_udf(part)
    def run(texts: pa.Array) -> pa.Array:
        found = tokenize(texts.to_pylist())
        sizes = [0 if t is None else len(t) for t in found]
        flat = [x for t in found if t is not None for x in t]
        columns = zip(*flat) if flat else ([], [], [])
        parts = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))]
        rows = pa.StructArray.from_arrays(parts, ["tok", "start", "end"])
        missing = np.array([t is None for t in found], bool)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, rows, mask=pa.array(missing) if missing.any() else None)

    return run


def span_offsets(tokens: Column, start: Column, end: Column) -> Column:
    """``struct<start,end>``: the tokens that hold a span's first and last character,
    among ``array<struct<tok,start,end>>``; NULL where no token does."""

    def holding(at: Column) -> Column:
        inside = F.transform(tokens, lambda t: (t["start"] <= at) & (at < t["end"]))
        return F.nullif(F.array_position(inside, True), F.lit(0)) - 1

    first = F.when(start >= 0, holding(start)).cast("long")
    last = F.when(end > 0, holding(end - 1)).cast("long")
    return F.struct(first.alias("start"), last.alias("end"))


def token_rows(df: DataFrame, text: str, *keep: str, token: str = TOKEN) -> DataFrame:
    """One row per token: the ``keep`` columns, ``pos``, ``tok``, ``start``, ``end``."""
    found = df.select(*keep, tokenize_offsets(text, token).alias("_t"))
    return found.select(*keep, F.posexplode("_t").alias("pos", "_x")).select(*keep, "pos", "_x.*")
