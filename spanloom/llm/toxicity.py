"""Toxic spans and document scores (method: linear-chain CRF, forward-backward marginals).

Words are tagged toxic or not by a conditional random field. Its token labels come
from labelled documents: a word is labelled toxic where it stands in a toxic
document and it, or one of its beginnings, has a document frequency among toxic
documents far above that among clean ones. Near copies count once in these
frequencies, by the least word hash of a document. Marginals of all words of a text are gathered to its expected number of
toxic words and its highest marginal, from which a logistic curve fitted on the
same labelled documents makes the score.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the
smallest hash of their id; scoring reads every text whole.

Defined cases: a null or empty text has no words and gets the score of a text
without toxic words; without labelled documents of both kinds every score is the
share of toxic ones (0 without any); labels that disagree on a document count as
toxic; repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm import crf
from spanloom.llm.words import PLAIN, Words, code_points, measure, text_chunks, word_hashes
from spanloom.session import cut_lineage

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 8192
#: Words of a training sequence; longer texts are cut into several. Texts are scored as one chain each.
SEQUENCE = 64
BUCKETS = 1 << 15
#: A word, or a beginning of words, is toxic from this share of the toxic documents,
#: so many of them, and so high odds on.
LEAST_SHARE = 0.01
LEAST_DOCS = 4
LEAST_ODDS = 20.0
#: Code points of the beginnings that are counted beside whole words.
BEGINNINGS = (4, 5, 6)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = SAMPLE) -> DataFrame:
    """``text`` and ``toxic`` of at most ``limit`` labelled documents; ``allowed`` is over the labels."""
    chosen = (
        labels.where(allowed & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(label).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(limit)
    )
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")


def _keys(word: str) -> list[str]:
    """The word and its beginnings, marked by a trailing dash."""
    return [word, *[word[:n] + "-" for n in BEGINNINGS if len(word) >= n]]


def _word_rows(batches):
    """Distinct words and beginnings of each document with its label and its least word hash."""
    for batch, texts in text_chunks(batches):
        words = Words(texts, PLAIN, lower=True)
        distinct, codes = words.codes()
        if not len(codes):
            continue
        hashes = word_hashes(distinct, 1)
        some = np.flatnonzero(words.counts)
        least = np.zeros(len(texts), np.uint64)
        least[some] = np.minimum.reduceat(hashes[codes], words.first[:-1][some])
        pair = np.unique(words.owner * len(distinct) + codes)
        owner, code = pair // len(distinct), pair % len(distinct)
        keys = [_keys(w) for w in distinct.to_pylist()]
        many = np.array([len(k) for k in keys])[code]
        owner = np.repeat(owner, many)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for c in code.tolist() for k in keys[c]], pa.string()),
                batch.column("toxic").take(pa.array(owner)),
                pa.array(least[owner].view(np.int64)),
            ],
            ["word", "toxic", "least"],
        )


def toxic_words(sample: DataFrame) -> list[str]:
    """Words and beginnings far more frequent among toxic documents than among clean ones."""
    seen = cut_lineage(sample.select("text", "toxic").mapInArrow(_word_rows, "word string, toxic int, least long").distinct())
    # documents are counted by the same keys as their words
    kinds = seen.select("toxic", "least").distinct().groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    n = {r["toxic"]: r["n"] for r in kinds.collect()}
    share = (n.get(0, 0) + 1) / (n.get(1, 0) + 1)
    counts = (
        seen
        .groupBy("word")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
        .where((F.col("bad") >= max(LEAST_DOCS, LEAST_SHARE * n.get(1, 0))) & ((F.col("bad") + 0.5) / (F.col("good") + 0.5) * share >= LEAST_ODDS))
    )
    return sorted(r["word"] for r in counts.collect())


def features(distinct: pa.Array) -> np.ndarray:
    """Per distinct word: buckets of the word and of its beginnings, and its length."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    raw = distinct.cast(pa.large_binary()).to_pylist()
    rows = [
        (
            digest(w, 1) % BUCKETS,
            BUCKETS + digest(w[:4], 2) % BUCKETS,
            2 * BUCKETS + digest(w[:6], 3) % BUCKETS,
            3 * BUCKETS + digest(w[:8], 4) % BUCKETS,
            4 * BUCKETS + min(len(w), 31),
        )
        for w in raw
    ]
    return np.array(rows, np.int64).reshape(-1, 5)


N_FEATURES = 4 * BUCKETS + 32


def _segments(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the sequences of all texts."""
    parts = -(-words.counts // SEQUENCE)
    inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(words.first[:-1], parts) + SEQUENCE * inside
    return first, np.minimum(SEQUENCE, np.repeat(words.first[1:], parts) - first)


def _training_rows(batches, lexicon: frozenset):
    """Features and tags of sequences with a word of the lexicon, and of each document's first one."""
    for batch, texts in text_chunks(batches):
        words = Words(texts, PLAIN, lower=True)
        distinct, codes = words.codes()
        if not len(codes):
            continue
        known = np.array([not lexicon.isdisjoint(_keys(w)) for w in distinct.to_pylist()])[codes]
        toxic = batch.column("toxic").to_numpy()
        first, length = _segments(words)
        hit = np.add.reduceat(known, first) > 0
        keep = np.flatnonzero(hit | np.isin(first, words.first[:-1]))
        table = features(distinct).astype(np.int32)[codes]
        tags = (known & (toxic[words.owner] > 0)).astype(np.int8)
        parts = list(zip(first[keep].tolist(), (first + length)[keep].tolist()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([table[a:b].tobytes() for a, b in parts], pa.binary()),
                pa.array([tags[a:b].tobytes() for a, b in parts], pa.binary()),
            ],
            ["features", "tags"],
        )


def _marginals(texts: pa.Array, model: dict) -> tuple[Words, np.ndarray]:
    """The probability of being toxic of every word."""
    field = crf.Model.load(model)
    words = Words(texts, PLAIN, lower=True)
    distinct, codes = words.codes()
    score = field.emissions(features(distinct))[codes]
    return words, crf.chain_marginals(score, words.first, field.transition, field.start)[:, 1]


def _gathered(words: Words, marginal: np.ndarray) -> np.ndarray:
    """Per text: expected toxic words (as a logarithm), highest marginal, and their share of the words."""
    sums = np.concatenate([[0.0], np.cumsum(marginal)])
    expected = np.maximum(sums[words.first[1:]] - sums[words.first[:-1]], 0)
    highest = np.zeros(len(expected))
    some = np.flatnonzero(words.counts)
    if len(some):
        highest[some] = np.maximum.reduceat(marginal, words.first[:-1][some])
    return np.stack([np.ones(len(expected)), np.log1p(expected), highest], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        hess = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (y - p) - l2 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, **names) -> dict:
    """The field and the curve from the labelled documents that ``allowed`` admits."""
    sample = cut_lineage(labelled_sample(docs, labels, allowed, **names))
    lexicon = frozenset(toxic_words(sample))
    # sequences of a bounded sample, as numbers
    rows = (
        sample.select("text", "toxic")
        .mapInArrow(lambda it: _training_rows(it, lexicon), "features binary, tags binary")
        .toArrow()
    )
    field = crf.Model(N_FEATURES, 2)
    if rows.num_rows:
        table = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("features")])
        tags = np.concatenate([np.frombuffer(x.as_buffer(), np.int8) for x in rows.column("tags")])
        sizes = np.array([len(x.as_buffer()) for x in rows.column("tags")])
        field.fit(table.reshape(-1, 5), tags.astype(np.int64), sizes, rounds=40)
    model = field.__dict__

    def gather(batches):
        for batch, texts in text_chunks(batches):
            x = _gathered(*_marginals(texts, model))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[:, k]) for k in (1, 2)] + [batch.column("toxic")], ["expected", "highest", "toxic"]
            )

    seen = sample.select("text", "toxic").mapInArrow(gather, "expected double, highest double, toxic int").collect()
    x = np.array([(1.0, r["expected"], r["highest"]) for r in seen]).reshape(-1, 3)
    y = np.array([r["toxic"] for r in seen], float)
    if 0 < y.sum() < len(y):
        return {"field": model, "curve": _logistic(x, y), "fixed": None}
    return {"field": model, "curve": np.zeros(3), "fixed": float(y.mean()) if len(y) else 0.0}


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def score(docs: DataFrame, model: dict, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``row``, ``score`` and ``spans``: code points of words that are more likely toxic than not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list:
        model = shared.value
        words, marginal = _marginals(texts, model["field"])
        x = _gathered(words, marginal)
        value = 1 / (1 + np.exp(-x @ model["curve"]))
        if model["fixed"] is not None:
            value[:] = model["fixed"]
        at = np.flatnonzero(marginal >= 0.5)
        owner = words.owner[at]
        points = np.concatenate([[0], np.cumsum(code_points(words.data))])
        base = points[words.offsets[owner]]
        span = pa.StructArray.from_arrays(
            [pa.array(points[words.starts[at]] - base), pa.array(points[words.ends[at]] - base)], ["start", "end"]
        )
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        return [value, pa.ListArray.from_arrays(pa.array(bounds), span)]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)]
    return measure(docs, run, fields, keep, text)
