"""Benchmark decontamination (method: prefix-filtered set join).

An item's windows are sets of word shingles. Containment of a whole window needs
every shingle, so its rarest one, by its count over all documents, is a sufficient
prefix. Document shingles are joined with the prefixes only; a candidate must fit
into the text at the prefix's offset (length and positional bounds) and is then
verified word by word.

The benchmark side is read in slices of at most ``SLICE_BYTES`` of text, so what a
task holds does not follow the benchmark's size; every document is matched against
every slice. Documents are not shuffled.

Defined cases: a null or empty text has no words; an item without words has no
window; a null item id counts as the empty string; repeated items and items with one id are one; an empty
benchmark hits nothing; a document id may repeat, each row is judged by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.words import PLAIN, Words, measure, text_chunks

WINDOW = 10
SHINGLE = 3
#: Text of a slice; its windows take about a hundred times as much memory where they are put in order.
SLICE_BYTES = 4 << 20


class Benchmark:
    """Windows of one slice of items as rows of word numbers."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        words = Words(pa.array([t or "" for t in texts], pa.large_string()), PLAIN, lower=True)
        self.vocab, codes = words.codes()
        self.ids = np.array(sorted(set(ids)), dtype=object)
        number = {x: i for i, x in enumerate(self.ids)}
        n, first = words.counts, words.first[:-1]
        size = np.minimum(n, window)
        many = np.where(n > 0, n - size + 1, 0)
        begin = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        size = np.repeat(size, many)
        rows = np.full((len(begin), window), -1, np.int64)
        for k in range(window):
            at = size > k
            rows[at, k] = codes[begin[at] + k]
        item = np.repeat(np.array([number[x] for x in ids], np.int64), many)
        self.rows, of = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, item)
        self.size = (self.rows >= 0).sum(axis=1)
        pairs = np.unique(np.stack([of.ravel(), item], axis=1), axis=0)
        self.item = pairs[:, 1]
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.widths = sorted(set(np.minimum(self.size, SHINGLE).tolist()))
        self.shingles = {w: np.unique(self._shingles(w)[0]) for w in self.widths}

    @classmethod
    def load(cls, state: dict) -> "Benchmark":
        """From the plain values that a broadcast carries."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def key(self, ids: np.ndarray) -> np.ndarray:
        """One number per row of word numbers; -1 where a word is unknown."""
        key = np.zeros(len(ids), np.int64)
        for k in range(ids.shape[1]):
            key = key * (len(self.vocab) + 1) + ids[:, k]
        return np.where((ids < 0).any(axis=1), -1, key)

    def _shingles(self, width: int):
        """Keys of the shingles of the windows that use this width, their windows and offsets."""
        rows = np.flatnonzero(np.minimum(self.size, SHINGLE) == width)
        keys, windows, offsets = [np.zeros(0, np.int64)], [rows[:0]], [rows[:0]]
        for k in range(self.rows.shape[1] - width + 1):
            at = rows[self.size[rows] >= k + width]
            keys.append(self.key(self.rows[at, k : k + width]))
            windows.append(at)
            offsets.append(np.full(len(at), k))
        return np.concatenate(keys), np.concatenate(windows), np.concatenate(offsets)

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Fix every window's prefix: its shingle with the lowest count, ties by offset."""
        self.prefix = {}
        for width in self.widths:
            key, window, offset = self._shingles(width)
            rarity = counts[width][np.searchsorted(self.shingles[width], key)]
            order = np.lexsort((offset, rarity, window))
            best = order[np.unique(window[order], return_index=True)[1]]
            best = best[np.argsort(key[best], kind="stable")]
            keys, at = np.unique(key[best], return_index=True)
            self.prefix[width] = (keys, np.append(at, len(best)), window[best], offset[best])

    def numbers(self, words: Words) -> np.ndarray:
        """Benchmark number of each document word, -1 for others."""
        import pyarrow.compute as pc

        distinct, codes = words.codes()
        known = pc.fill_null(pc.index_in(distinct, self.vocab), -1).to_numpy(zero_copy_only=False)
        return known.astype(np.int64)[codes] if len(codes) else codes

    def _keys(self, ids: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys of document shingles made of benchmark words only."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ok = owner[:n] == owner[width - 1 :]
        for k in range(width):
            ok &= ids[k : n + k] >= 0
        at = np.flatnonzero(ok)
        return at, self.key(np.stack([ids[at + k] for k in range(width)], axis=1))

    def count(self, texts: pa.Array) -> dict[int, np.ndarray]:
        """Occurrences of the benchmark's shingles in the texts, by width."""
        words = Words(texts, PLAIN, lower=True)
        ids, owner, out = self.numbers(words), words.owner, {}
        for width, known in self.shingles.items():
            key = self._keys(ids, owner, width)[1]
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            out[width] = np.bincount(at[known[at] == key], minlength=len(known))
        return out

    def match(self, texts: pa.Array):
        """Number of words, covered words as runs (text, start, end), and (text, item) pairs."""
        words = Words(texts, PLAIN, lower=True)
        ids, owner = self.numbers(words), words.owner
        cover = np.zeros(len(words) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for width, (keys, first, window, offset) in self.prefix.items():
            at, key = self._keys(ids, owner, width)
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found = keys[slot] == key
            at, slot = at[found], slot[found]
            many = first[slot + 1] - first[slot]
            entry = np.repeat(first[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            text, begin = np.repeat(owner[at], many), np.repeat(at, many) - offset[entry]
            row = window[entry]
            ok = (begin >= words.first[text]) & (begin + self.size[row] <= words.first[text + 1])
            text, begin, row = text[ok], begin[ok], row[ok]
            for k in range(self.rows.shape[1]):
                want = self.rows[row, k]
                ok = want < 0
                ok |= ids[np.minimum(begin + k, len(ids) - 1)] == want
                text, begin, row = text[ok], begin[ok], row[ok]
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + self.size[row], -1)
            many = self.item_at[row + 1] - self.item_at[row]
            entry = np.repeat(self.item_at[row], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.stack([np.repeat(text, many), self.item[entry]], axis=1))
        return words, np.cumsum(cover[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _slices(benchmark: DataFrame, item_id: str, text: str, limit: int) -> tuple[DataFrame, int]:
    """Items with a slice number; a slice has at most ``limit`` bytes of text, or one item."""
    rows = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"),
        F.col(f"`{text}`").alias("text"),
    )
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, -(-size * 2 // limit)) if size > limit else 1
    return rows.withColumn("slice", F.pmod(F.xxhash64("item_id"), F.lit(n))), n


def _count_pass(docs: DataFrame, text: str, shared) -> dict[int, np.ndarray]:
    def run(batches):
        index, total = Benchmark.load(shared.value), None
        for _, texts in text_chunks(batches):
            now = index.count(texts)
            total = now if total is None else {w: total[w] + now[w] for w in now}
        for width, n in (total or {}).items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), width)), pa.array(at), pa.array(n[at])], ["width", "at", "n"]
            )

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "width long, at long, n long")
    counts = {w: np.zeros(len(k), np.int64) for w, k in shared.value["shingles"].items()}
    # as many rows as the slice has shingles, at most
    for r in rows.groupBy("width", "at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.width][r.at] = r.n
    return counts


HIT = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, limit: int = SLICE_BYTES) -> DataFrame:
    """``row``, ``n_words``, ``spans`` (hit words, start and end exclusive) and sorted ``items``."""
    spark = docs.sparkSession
    items, n = _slices(benchmark, item_id, item_text, limit)
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", HIT),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
    if n > 1:
        return _many_slices(docs, items, n, keep, text, window, fields)
    return _one_slice(spark, docs, docs, items, keep, text, window, fields)


def _one_slice(spark, all_docs, docs, items, keep, text, window, fields) -> DataFrame:
    rows = items.select("item_id", "text").collect()  # at most one slice
    index = Benchmark([r.item_id for r in rows], [r.text for r in rows], window)
    index.choose(_count_pass(all_docs, text, spark.sparkContext.broadcast(index.__dict__)))
    shared = spark.sparkContext.broadcast(index.__dict__)

    def run(texts: pa.Array) -> list:
        index = Benchmark.load(shared.value)
        words, hit, pairs = index.match(texts)
        owner = words.owner
        before = np.concatenate([[False], hit[:-1] & (owner[1:] == owner[:-1])]) if len(hit) else hit
        after = np.concatenate([hit[1:] & (owner[1:] == owner[:-1]), [False]]) if len(hit) else hit
        start, end = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
        of = owner[start]
        span = pa.StructArray.from_arrays(
            [pa.array(start - words.first[of]), pa.array(end - words.first[of])], ["start", "end"]
        )
        span_at = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
        item_at = np.searchsorted(pairs[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
        names = pa.array(index.ids[pairs[:, 1]].tolist(), pa.string())
        return [
            words.counts,
            pa.ListArray.from_arrays(pa.array(span_at), span),
            pa.ListArray.from_arrays(pa.array(item_at), names),
        ]

    return measure(docs, run, fields, keep, text)


def _many_slices(docs, items, n, keep, text, window, fields) -> DataFrame:
    """Matches each slice in turn, then unites what the slices found in a row."""
    spark = docs.sparkSession
    names = docs.columns if keep is None else keep
    now = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text")
    ).withColumns({"spans": F.lit(None).cast(HIT), "items": F.lit(None).cast("array<string>")})
    for k in range(n):
        found = _one_slice(
            spark, docs, now, items.where(F.col("slice") == k), ["row", "text", "spans", "items"], "text", window, fields
        )
        now = found.select(
            "row.row", "row.text", "n_words",
            _united(F.concat(F.coalesce("row.spans", F.array().cast(HIT)), "spans")).alias("spans"),
            F.array_sort(F.array_union(F.coalesce("row.items", F.array().cast("array<string>")), "items")).alias("items"),
        )
    return now.select("row", "n_words", "spans", "items")


def _united(spans):
    """Sorted spans with touching and overlapping ones joined."""
    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        apart = (F.size(done) == 0) | (F.get(done, F.size(done) - 1)["end"] < x["start"])
        return F.when(apart, F.concat(done, F.array(x))).otherwise(
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        )

    return F.aggregate(F.array_sort(spans), F.array().cast(HIT), add)


def n_hit() -> Column:
    """Words inside the spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows without a benchmark window, columns unchanged."""
    return hits(docs, benchmark, **names).where(F.size("spans") == 0).select("row.*")
