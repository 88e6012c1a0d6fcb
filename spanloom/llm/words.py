"""Words of Arrow text batches as index arrays, and the Spark call that feeds them.

Every text is taken whole. Batches are cut between documents into chunks of about
``CHUNK_BYTES`` so that a worker's memory does not follow the size of a batch; a
longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import bound_batches

CHUNK_BYTES = 8 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, true outside the given inclusive byte ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for texts whose A-Z are lower-cased
PLAIN = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

#: A-Z to a-z, all other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array without nulls, and its offsets into them."""
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Consecutive slices of ``data`` as strings."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1,
        pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
        pa.py_buffer(np.ascontiguousarray(data)),
    )


class Words:
    """The words of a chunk: ``starts`` and ``ends`` in ``data``, ``first`` word of each text.

    ``first`` has one more element than there are texts. ``data`` is lower-cased
    where asked for.
    """

    def __init__(self, texts: pa.Array, kept: np.ndarray, lower: bool = False):
        data, self.offsets = text_buffer(texts)
        self.data = LOWER[data] if lower else data
        self.inside = kept[self.data]
        before = np.empty_like(self.inside)
        before[1:] = self.inside[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < self.offsets[-1]]
        before[edges] = False
        self.starts = np.flatnonzero(self.inside & ~before)
        after = np.empty_like(self.inside)
        after[:-1] = self.inside[1:]
        edges = self.offsets[1:][self.offsets[1:] > 0]
        after[edges - 1] = False
        self.ends = np.flatnonzero(self.inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.first[-1] = len(self.starts)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def strings(self) -> pa.Array:
        """The words as strings."""
        offsets = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        return strings(self.data[self.inside], offsets)

    def codes(self) -> tuple[pa.Array, np.ndarray]:
        """Distinct words and, for each word, its number among them."""
        coded = self.strings().dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text stands alone."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    start = 0
    while start < len(texts):
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield start, stop
        start = stop


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text"):
    """(chunk of the batch, its texts with null as empty) for each chunk."""
    for batch in batches:
        texts = batch.column(column)
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        for start, stop in chunks(texts, limit):
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)


def measure(
    docs: DataFrame,
    fn: Callable[[pa.Array], list],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    text: str = "text",
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """``row`` (a struct of the kept columns, by default all) beside what ``fn`` says of each text.

    ``fn`` takes an array of whole texts, null as empty, and returns one array per
    field. The rows stay as they are, whatever their columns are called.
    """
    bound_batches(docs.sparkSession, CHUNK_BYTES)
    names = docs.columns if keep is None else keep
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text")
    )
    schema = T.StructType([rows.schema["row"], *fields])

    def run(batches):
        for batch, texts in text_chunks(batches, limit):
            columns = [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *columns], names=["row", *[f.name for f in fields]]
            )

    return rows.mapInArrow(run, schema)


def word_hashes(words: pa.Array, seed: int) -> np.ndarray:
    """XXH64 of each distinct word."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(x, seed) for x in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words)
    )
