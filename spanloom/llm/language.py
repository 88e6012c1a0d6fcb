"""Language identification (method: scripts, then Viterbi over words with a switching penalty).

The script of a word leaves those languages that use it. Each is scored by byte
trigrams, and Viterbi with a penalty for every change of language labels the spans
of a text. The prediction is the language that covers most letters; the score is
its share of them.

The trigram model is fitted on at most ``SAMPLE`` labelled documents, those with
the smallest hash of their id; prediction reads every text whole.

Defined cases: a null or empty text, one without letters, or a model without
languages gives ``und`` and score 0; a tie goes to the first language by name;
repeated rows get equal predictions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm import crf
from spanloom.llm.simhash import joined_words
from spanloom.llm.words import PLAIN, Words, code_points, measure, text_chunks

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 8192
BUCKETS = 1 << 17
#: Natural logarithm that a change of language costs, and what rules a language out for a word in a script that others have.
SWITCH = 8.0
FOREIGN = 1e6
#: A script belongs to a language from this share of its words on.
SCRIPT_SHARE = 0.01

# First code points of Unicode script ranges, up to the next one.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_FIRST = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


class Spelling:
    """Distinct words of a chunk: bucketed byte trigrams with a space on both sides, script, letters."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts, PLAIN, lower=True)
        distinct, self.codes = self.words.codes()
        as_words = Words(distinct, np.ones(256, bool))
        raw, at = joined_words(as_words)
        data = np.frombuffer(b" " + raw, np.uint8).astype(np.int64)
        gram = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:] if len(data) > 2 else data[:0]
        # the trigrams of a word begin before its first byte and end behind its last
        self.begin = at[:-1]
        self.grams = (gram * 0x9E3779B1 >> 7) % BUCKETS
        self.size = np.diff(at) - 1
        ascii_letter = (as_words.data >= 0x61) & (as_words.data <= 0x7A)
        letters = np.concatenate([[0], np.cumsum(ascii_letter | (as_words.data >= 0x80))])
        self.letters = letters[as_words.ends] - letters[as_words.starts]
        self.script = _SCRIPT[np.searchsorted(_FIRST, self._first_points(as_words), side="right") - 1]

    @staticmethod
    def _first_points(words: Words) -> np.ndarray:
        """The first code point of each word."""
        data = np.concatenate([words.data, np.zeros(3, np.uint8)]).astype(np.int64)
        a, b, c = (data[words.starts + k] for k in range(3))
        two, three = ((a & 0x1F) << 6) | (b & 0x3F), ((a & 0x0F) << 12) | ((b & 0x3F) << 6) | (c & 0x3F)
        return np.select([a < 0x80, a < 0xE0, a < 0xF0], [a, two, three], 0xFFFF)

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Sum of a (bucket, language) table over the trigrams of each distinct word."""
        out = np.zeros((len(self.size), table.shape[1]))
        if len(self.size):
            for k in range(table.shape[1]):
                value = np.append(table[:, k][self.grams], (0.0, 0.0))
                out[:, k] = np.add.reduceat(value, self.begin)
        return out


def _count(batches, langs: list[str]):
    """Counts of trigrams and of scripts by language, of a task's documents."""
    number = {x: i for i, x in enumerate(langs)}
    grams, scripts = np.zeros((len(langs), BUCKETS), np.int64), np.zeros((len(langs), len(SCRIPT_NAMES)), np.int64)
    for batch, texts in text_chunks(batches):
        lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
        spelling = Spelling(texts)
        if not len(spelling.codes):
            continue
        of = lang[spelling.words.owner]
        many = np.bincount(of * len(spelling.size) + spelling.codes, minlength=len(langs) * len(spelling.size))
        for k, n in enumerate(many.reshape(len(langs), -1)):
            per_gram = np.repeat(n, np.diff(np.append(spelling.begin, len(spelling.grams))))
            grams[k] += np.bincount(spelling.grams, weights=per_gram, minlength=BUCKETS).astype(np.int64)
            scripts[k] += np.bincount(spelling.script, weights=n, minlength=len(SCRIPT_NAMES)).astype(np.int64)
    for k in range(len(langs)):
        for kind, row in ((0, grams[k]), (1, scripts[k])):
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), x)) for x in (k, kind)] + [pa.array(at), pa.array(row[at])],
                ["lang", "kind", "at", "n"],
            )


def fit(docs: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = SAMPLE) -> dict:
    """Languages, log probabilities (bucket, language) and their scripts, from admitted documents."""
    chosen = (
        docs.where(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("_id"), F.col(lang).alias("lang"))
        .orderBy(F.xxhash64("_id"), "_id", "lang")
        .limit(limit)
        .distinct()
    )
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id").select("text", "lang")
    langs = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    grams, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    if langs:
        counts = sample.mapInArrow(lambda it: _count(it, langs), "lang long, kind long, at long, n long")
        # at most BUCKETS rows per language
        for r in counts.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toLocalIterator():
            (scripts if r["kind"] else grams)[r["at"], r["lang"]] = r["n"]
    total = grams.sum(axis=0)
    return {
        "langs": langs,
        "table": np.log((grams + 0.1) / (total + 0.1 * BUCKETS)) if langs else grams,
        "scripts": scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1),
    }


def spans(score: np.ndarray, there: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best language (step, text) of every word for ``score`` (step, text, language)."""
    steps, n, k = score.shape
    stay = np.ones((steps, n, k), bool)
    origin = np.zeros((steps, n), np.int8)
    best = score[0].copy()
    for t in range(1, steps):
        top = best.max(axis=1)
        origin[t] = best.argmax(axis=1)
        other = (top - penalty)[:, None]
        stay[t] = (best >= other) | ~there[t][:, None]
        # a row that has ended keeps its values: its scores are zero and nothing switches
        best = np.where(there[t][:, None], np.maximum(best, other) + score[t], best)
    out = np.zeros((steps, n), np.int8)
    out[-1] = best.argmax(axis=1)
    at = np.arange(n)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = np.where(stay[t, at, out[t]], out[t], origin[t])
    return out


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])


def _runs(words: Words, change: np.ndarray, langs: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The runs that begin at ``change``, as lists of ``counts`` of them per text."""
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(change))[: len(first)] - 1
    chars = np.concatenate([[0], np.cumsum(code_points(words.data))])
    base = chars[words.offsets[:-1]][words.owner[first]]
    parts = [chars[words.starts[first]] - base, chars[words.ends[last]] - base]
    names = pa.array(langs[first].tolist(), pa.string())
    rows = pa.StructArray.from_arrays([*(pa.array(x, pa.int64()) for x in parts), names], ["start", "end", "lang"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), rows)


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``row``, ``lang_pred``, ``score``, ``n_spans`` and ``spans``: the runs of one language in the text.

    A span has ``start`` and ``end`` (code points, end exclusive) of its words and ``lang``; a
    text without words has none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list:
        model = shared.value
        langs = np.array([*model["langs"], "und"], dtype=object)
        k = len(langs) - 1
        spelling = Spelling(texts)
        words = spelling.words
        lettered = spelling.letters[spelling.codes] > 0
        points = spelling.letters[spelling.codes]
        owner = words.owner
        weight = np.zeros((len(texts), max(k, 1)))
        n_spans = np.zeros(len(texts), np.int64)
        change, label = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        if k:
            score = spelling.scores(model["table"])
            fits = model["scripts"][spelling.script]
            score -= np.where(fits | ~fits.any(axis=1, keepdims=True), 0.0, FOREIGN)
            score[spelling.letters == 0] = 0.0
            for group in crf.batches(words.counts, (1 << 20) // max(k, 4)):
                at, there = crf.padded(words.first[group], words.counts[group])
                label[at[there]] = spans(np.where(there[:, :, None], score[spelling.codes[at]], 0.0), there)[there]
            weight = np.bincount(owner * k + label, weights=points, minlength=len(texts) * k).reshape(-1, k)
            change = np.ones(len(words), bool)
            change[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
            n_spans = np.bincount(owner[change], minlength=len(texts))
        total = weight.sum(axis=1)
        known = np.bincount(owner[lettered], minlength=len(texts)) > 0
        low = (words.data >= 0x61) & (words.data <= 0x7A)
        marks = np.concatenate([[0], np.cumsum(low)])[words.offsets]
        ascii_only = np.diff(marks) > 0
        for i in np.flatnonzero(known & ~ascii_only).tolist():
            known[i] = any(c.isalpha() for c in texts[i].as_py())
        known &= total > 0
        best = np.where(known, weight.argmax(axis=1), k)
        share = np.where(known, weight.max(axis=1) / np.maximum(total, 1), 0.0)
        return [pa.array(langs[best].tolist(), pa.string()), share, n_spans, _runs(words, change, langs[label], n_spans)]

    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("spans", T.ArrayType(_SPAN)),
    ]
    return measure(docs, run, fields, keep, text)
