"""Array work on Arrow batches, where SQL would need a lambda per element or a
shuffle to number and gather elements. Everything here is vectorised; no Python
code runs per element or per row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import bound_batches


def _like(lists: pa.ListArray, values: pa.Array) -> pa.Array:
    """The same lists with other values; NULL lists stay NULL."""
    mask = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(lists.offsets, values, mask=mask)


def _positions(lists: pa.ListArray) -> np.ndarray:
    """0-based position of every value within its list."""
    offsets = lists.offsets.to_numpy()
    return np.arange(len(lists.values)) - np.repeat(offsets[:-1], np.diff(offsets))


def with_offsets(tokens: Column, gaps: Column) -> Column:
    """``array<struct<tok,start,end>>`` from tokens and the gaps around them (one
    more gap than tokens); offsets count code points."""
    bound_batches()
    part = T.StructType(
        [
            T.StructField("tok", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )

    @F.arrow_udf(T.ArrayType(part))
    def place(words: pa.Array, between: pa.Array) -> pa.Array:
        def sizes(lists: pa.Array) -> np.ndarray:
            return pc.utf8_length(lists.values).to_numpy(zero_copy_only=False).astype(np.int64)

        size = sizes(words)
        offsets = words.offsets.to_numpy()
        row = np.repeat(np.arange(len(words)), np.diff(offsets))
        # The gap ahead of a token stands at the same place among its row's gaps.
        gap = sizes(between)[between.offsets.to_numpy()[:-1][row] + _positions(words)]
        total = np.concatenate([[0], np.cumsum(size + gap)])
        end = total[1:] - total[offsets[:-1]][row]
        parts = [words.values, pa.array(end - size), pa.array(end)]
        return _like(words, pa.StructArray.from_arrays(parts, ["tok", "start", "end"]))

    return place(tokens, gaps)


def text_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit number for each text without NULLs; equal texts have equal numbers."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(at)
    place = np.arange(len(raw)) - np.repeat(at[:-1] - at[0], sizes)
    power = np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    # sums and products wrap around at 64 bits
    weighed = np.append((raw.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(power)[place], np.uint64(0))
    out = np.where(sizes > 0, np.add.reduceat(weighed, at[:-1] - at[0]), np.uint64(0)) if len(sizes) else np.zeros(0, np.uint64)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


class KeyTable:
    """Two arrays as a lookup table: keys, text or whole numbers without repeats, sorted by hash.

    Three flat arrays that a worker reads as they come; nothing is built per worker.
    """

    def __init__(self, keys: pa.Array, values: pa.Array):
        self.text = pa.types.is_string(keys.type) or pa.types.is_large_string(keys.type)
        marks = self._marks(keys)
        order = np.argsort(marks, kind="stable")
        self.marks, self.keys, self.values = marks[order], keys.take(pa.array(order)), values.take(pa.array(order))
        same = np.flatnonzero(np.append(self.marks[1:] != self.marks[:-1], True))
        #: keys of one hash are looked at one after the other
        self.run = int(np.diff(np.append(-1, same)).max(initial=0))

    def _marks(self, keys: pa.Array) -> np.ndarray:
        return text_hashes(keys) if self.text else keys.to_numpy(zero_copy_only=False)

    def find(self, keys: pa.Array) -> pa.Array:
        """The values of the keys, NULL for unknown and NULL ones."""
        known = self.places(keys)
        return self.values.take(pa.array(known, mask=known < 0))

    def places(self, keys: pa.Array) -> np.ndarray:
        """Where the values of the keys stand, -1 for unknown and NULL ones."""
        known = np.zeros(len(keys), np.int64) - 1
        valid = np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False))
        asked = keys.take(pa.array(valid))
        marks = self._marks(asked)
        at = np.searchsorted(self.marks, marks)
        for step in range(self.run):
            here = np.minimum(at + step, len(self.marks) - 1)
            equal = self.marks[here] == marks
            if self.text:
                equal &= pc.equal(self.keys.take(pa.array(here)).cast(asked.type), asked).to_numpy(zero_copy_only=False)
            known[valid[equal]] = here[equal]
        return known


def lookup(arrays: Column, table: Broadcast, missing, result: T.DataType) -> Column:
    """Replaces every element by its partner in a broadcast ``KeyTable``; unknown elements
    become ``missing``. A batch looks up its distinct elements only."""
    bound_batches()

    @F.arrow_udf(T.ArrayType(result))
    def find(lists: pa.Array) -> pa.Array:
        coded = lists.values.dictionary_encode()
        found = table.value.find(coded.dictionary).take(coded.indices)
        return _like(lists, pc.fill_null(found, missing))

    return find(arrays)


def dictionary_chunks(column: str, size: int, head: Broadcast | None = None) -> Callable:
    """For ``mapInArrow`` over ``row`` and an array column: ``chunk, row, codes, words``.

    Rows are numbered in chunks of about ``size`` elements. A code is the place of an element's
    partner in the ``KeyTable`` ``head``; elements that it does not have count down from -1 by
    their place in ``words``, the distinct ones of the chunk, which are on its first row only.
    NULL elements have no code.
    """

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column(column)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                base = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + size, side="right")))
                part = lists.slice(lo, hi - lo)
                coded = part.flatten().dictionary_encode()
                place = np.full(len(coded.dictionary), -1) if head is None else head.value.places(coded.dictionary)
                rest = place < 0
                place[rest] = -1 - np.arange(rest.sum())
                left = coded.dictionary.filter(pa.array(rest))
                sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                mask = part.is_null() if part.null_count else None
                codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place, pa.int32()).take(coded.indices), mask=mask)
                first = np.full(hi - lo + 1, len(left), np.int32)
                first[0] = 0
                words = pa.ListArray.from_arrays(pa.array(first), left, mask=pa.array(np.arange(hi - lo) > 0))
                chunk = pa.array(np.full(hi - lo, number), pa.int64())
                yield pa.RecordBatch.from_arrays([chunk, batch.column("row").slice(lo, hi - lo), codes, words], names=["chunk", "row", "codes", "words"])
                number, lo = number + 1, hi

    return run


def decode_chunks(out: str, names: list[str], missing, head: Broadcast | None = None) -> Callable:
    """For a cogroup of coded rows with ``pos, to`` of their chunk's words: the rows with ``out``."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        codes, row = (rows[c].chunk(0) for c in ("codes", "row"))
        code = pc.fill_null(codes.values, 0).to_numpy()
        known = codes.values.is_valid().to_numpy(zero_copy_only=False)
        partners = found.sort_by("pos")["to"].combine_chunks()
        taken = partners.take(pa.array(-1 - code, mask=~known | (code >= 0)))
        if head is not None:
            taken = pc.coalesce(taken, head.value.values.cast(taken.type).take(pa.array(code, mask=~known | (code < 0))))
        columns = [row.field(n) for n in names]
        return pa.Table.from_arrays([*columns, _like(codes, pc.fill_null(taken, missing))], names=[*names, out])

    return run


def map_lists(
    fn: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], names: list[str]
) -> Callable[[Column, Column], Column]:
    """Column function ``(array<bigint>, bigint) -> struct of arrays`` from a numpy
    function ``(values, positions, row numbers) -> {name: values}``."""
    struct = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in names])
    bound_batches()

    @F.arrow_udf(struct)
    def apply(lists: pa.Array, rows: pa.Array) -> pa.Array:
        counts = np.diff(lists.offsets.to_numpy())
        row = np.repeat(rows.to_numpy(zero_copy_only=False), counts)
        out = fn(lists.values.to_numpy(zero_copy_only=False), _positions(lists), row)
        return pa.StructArray.from_arrays([_like(lists, pa.array(out[n])) for n in names], names)

    return apply
