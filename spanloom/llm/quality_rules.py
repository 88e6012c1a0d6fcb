"""Quality rules as a bitmask ledger (method: rule bitmask ledger).

Every rule is evaluated once per document. The ledger keeps the measurements and
one failure bit per rule; a policy is a version name with the bits that reject.
Policies are applied to the stored ledger without reading texts again, and
ablations are bitwise aggregates over it.

Defined cases: a null or empty text has no words, so all measurements are 0 and
the rule ``few_words`` fails. Repeated rows are judged one by one. An empty table
gives an empty ledger. Columns beside the text are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.words import SPACED, Words, byte_class, code_points, measure, totals

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_SYMBOL = ~byte_class(*[(ord(c), ord(c)) for c in "#*$%&|<>"])


def repeated_windows(codes: np.ndarray, owner: np.ndarray, width: int = 3) -> np.ndarray:
    """True for words inside a window of ``width`` words found twice or more in its text."""
    hit = np.zeros(len(codes), bool)
    n = len(codes) - width + 1
    if n <= 0:
        return hit
    key, size = codes[:n], int(codes.max()) + 1
    for k in range(1, width):
        if key.max() >= (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + codes[k : n + k]
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    # texts ascend within equal keys, as the sort is stable
    same = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    begins = order[again]
    for k in range(width):
        hit[begins + k] = True
    return hit


def measurements(texts: pa.Array) -> list[np.ndarray]:
    """``MEASURES`` of each whole text."""
    words = Words(texts, SPACED)
    _, codes = words.codes()
    owner = words.owner
    repeat = totals(repeated_windows(codes, owner), words.first)
    chars = totals(code_points(words.data) & words.inside, words.offsets)
    symbols = totals(_SYMBOL[words.data], words.offsets)
    lines = Words(texts, byte_class((0x0A, 0x0A)))
    worded = np.diff(np.searchsorted(words.starts, np.append(lines.starts, len(words.data)))) > 0
    line_codes = lines.codes()[1]
    key = (lines.owner * (int(line_codes.max(initial=0)) + 1) + line_codes)[worded]
    line_owner = lines.owner[worded]
    n_lines = np.bincount(line_owner, minlength=len(texts))
    distinct = np.bincount(line_owner[np.unique(key, return_index=True)[1]], minlength=len(texts))
    return [words.counts, chars, symbols, n_lines, n_lines - distinct, repeat]


@dataclass(frozen=True)
class Rule:
    """Fails where the condition over the measurements is true; ``bit`` never changes its rule."""

    bit: int
    name: str
    fails: Column


def rules() -> list[Rule]:
    """All rules, built where a session is at hand."""
    c = F.col
    return [
        Rule(0, "few_words", c("n_words") < 50),
        Rule(1, "repeated_words", 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule(2, "symbols", 100 * c("n_symbols") > 30 * c("n_words")),
        Rule(3, "repeated_lines", 100 * c("n_dup_lines") > 30 * c("n_lines")),
        Rule(4, "short_words", 10 * c("word_chars") < 25 * c("n_words")),
        Rule(5, "long_words", c("word_chars") > 15 * c("n_words")),
    ]


BASE = (1 << 0) | (1 << 1)
#: Which failures reject, by version. A published version is never edited.
POLICIES = {"base": BASE, "v1": BASE | (1 << 2), "v2": (1 << 6) - 1}
#: ``v2`` also rejects for repeated lines, which some documents labelled as good have.
CURRENT = "v1"


def _bits(rule_set: list[Rule]) -> Column:
    bits = F.lit(0).cast("long")
    for rule in rule_set:
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << rule.bit)).otherwise(0).cast("long"))
    return bits


def ledger(
    docs: DataFrame,
    keep: list[str] | None = None,
    rule_set: list[Rule] | None = None,
    text: str = "text",
) -> DataFrame:
    """``row`` (the kept columns), ``MEASURES`` and ``failed``, one bit per rule."""
    fields = [T.StructField(m, T.LongType()) for m in MEASURES]
    return measure(docs, measurements, fields, keep, text).withColumn(
        "failed", _bits(rules() if rule_set is None else rule_set)
    )


def passes(policy: str = CURRENT) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with the policy's verdict."""
    return book.withColumn("kept", passes(policy))


def ablations(book: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """Per policy and rule: rows that fail the rule, and rows that only this rule rejects.

    The ledger is first aggregated to distinct failure masks, at most 2 to the
    number of rules, on which everything else works bitwise.
    """
    masks = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    table = F.array(
        *[
            F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("mask"))
            for p, m in (POLICIES if policies is None else policies).items()
        ]
    )
    names = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
            for r in rules()
        ]
    )
    hits = F.col("failed").bitwiseAND(F.col("mask"))
    return (
        masks.select("failed", "n", F.inline(table))
        .select("policy", "mask", "n", hits.alias("hits"), F.inline(names))
        .where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(F.col("hits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("hits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("hits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        )
    )


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows that the policy keeps, columns unchanged."""
    return ledger(docs).where(passes(policy)).select("row.*")
