"""Elements of a large array inside JSON objects, read by byte ranges.

A file that is one JSON object cannot be cut by lines. It is cut at closing braces
instead, wherever those stand: Spark reads byte ranges as usual, with ``}`` as the line
separator. Whether a range begins inside a text, and how deep, follows from the ranges
before it, so a first pass sums up each range for both cases (inside a text or not), and
the sums of a file's ranges, a few numbers each, are folded in file order. The second
pass then knows where the elements of the array begin and end. Elements that lie in one
range are whole; only the pieces of the others, at most two a range, are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.session import broadcast_if_small, cut_lineage
from spanloom.sources.text import pin_splits

QUOTE, BACKSLASH, OPEN_OBJECT, CLOSE_OBJECT, OPEN_LIST, CLOSE_LIST = (ord(c) for c in '"\\{}[]')
#: Depth inside the object that a file consists of, and inside the array looked for.
ROOT, ARRAY = 1, 2

SUMS = "f long, block long, flips int, d0 long, m0 long, c0 array<long>, d1 long, m1 long, c1 array<long>"
PIECES = "f long, block long, at long, begins boolean, ends boolean, text string"


class Scan:
    """Structure of a stretch of JSON that begins behind a ``}`` or at the beginning of a file."""

    def __init__(self, pieces: pa.Array, key: re.Pattern):
        # the reader took the separators away; one too many behind a file's last line end does no harm
        joined = pc.binary_join_element_wise(pieces.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"}", pa.large_binary()))
        _, offsets, data = joined.buffers()
        at = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        b = self.data
        slash = b == BACKSLASH
        quote = b == QUOTE
        if slash.any():
            # a quote behind an odd run of backslashes is part of a text; no run crosses a brace
            index = np.arange(len(b))
            last_other = np.maximum.accumulate(np.where(slash, -1, index))
            before = np.zeros(len(b), np.int64)
            before[1:] = (index - last_other)[:-1]
            quote &= before % 2 == 0
        self.quote = quote
        self.quotes = np.cumsum(quote)
        self.step = ((b == OPEN_OBJECT) | (b == OPEN_LIST)).astype(np.int8) - ((b == CLOSE_OBJECT) | (b == CLOSE_LIST)).astype(np.int8)
        found = list(key.finditer(self.data.tobytes()))
        self.key_quote = np.array([m.start() for m in found], np.int64)
        self.key_list = np.array([m.end() - 1 for m in found], np.int64)

    @property
    def flips(self) -> int:
        return int(self.quotes[-1]) % 2 if len(self.quotes) else 0

    def moves(self, inside: int) -> np.ndarray:
        """+1 where something opens and -1 where it closes, if the stretch begins ``inside`` a text or not."""
        return np.where((self.quotes + inside) % 2 == 0, self.step, 0)

    def lists(self, inside: int) -> np.ndarray:
        """Where arrays behind the key open."""
        real = self.quote[self.key_quote] & ((self.quotes[self.key_quote] - 1 + inside) % 2 == 0)
        return self.key_list[real]


@dataclass
class Sum:
    """What a stretch does to depth, for one of the two cases."""

    depth: int = 0
    low: int = 0
    open: list[int] = field(default_factory=list)

    def add(self, moves: np.ndarray, lists: np.ndarray) -> None:
        if not len(moves):
            return
        depth = self.depth + np.cumsum(moves)
        low_behind = np.minimum.accumulate(depth[::-1])[::-1]
        self.open = [d for d in self.open if low_behind[0] >= d]
        self.open += sorted({int(depth[i]) for i in lists if low_behind[i] >= depth[i]})
        self.low = min(self.low, int(low_behind[0]))
        self.depth = int(depth[-1])


@dataclass(frozen=True)
class State:
    """Where a range begins: inside a text, how deep, and whether in the array."""

    inside: int = 0
    depth: int = 0
    in_array: bool = False

    def after(self, flips: int, sums: tuple[tuple[int, int, list[int]], ...]) -> State:
        depth, low, opened = sums[self.inside]
        still = self.in_array and self.depth + low >= ARRAY
        return State(self.inside ^ flips, self.depth + depth, still or any(self.depth + d == ARRAY for d in opened))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """The parts of batches that belong to one byte range."""
    for batch in batches:
        f, block = (batch.column(c).to_numpy() for c in ("f", "block"))
        cuts = np.flatnonzero((f[1:] != f[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(f)], strict=True):
            if hi > lo:
                yield int(f[lo]), int(block[lo]), batch.slice(lo, hi - lo)


def _pattern(key: str) -> re.Pattern:
    return re.compile(rb'"' + re.escape(key.encode()) + rb'"[ \t\r\n]*:[ \t\r\n]*\[')


def _summed(key: str):
    pattern = _pattern(key)

    def run(batches):
        at, flips, cases = None, 0, (Sum(), Sum())

        def row():
            values = [*at, flips, *[v for c in cases for v in (c.depth, c.low, c.open)]]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, [pa.int64(), pa.int64(), pa.int32(), *[pa.int64(), pa.int64(), pa.list_(pa.int64())] * 2], strict=True)],
                names=["f", "block", "flips", "d0", "m0", "c0", "d1", "m1", "c1"],
            )

        for f, block, part in _runs(batches):
            if at != (f, block):
                if at is not None:
                    yield row()
                at, flips, cases = (f, block), 0, (Sum(), Sum())
            scan = Scan(part.column("value"), pattern)
            for case, total in enumerate(cases):
                inside = case ^ flips
                total.add(scan.moves(inside), scan.lists(inside))
            flips ^= scan.flips
        if at is not None:
            yield row()

    return run


def _folded(key: tuple, table: pa.Table) -> pa.Table:
    """The state at the beginning of each range of a file."""
    state, out = State(), []
    for r in table.sort_by("block").to_pylist():
        out.append((r["f"], r["block"], state.inside, state.depth, state.in_array))
        state = state.after(r["flips"], ((r["d0"], r["m0"], r["c0"]), (r["d1"], r["m1"], r["c1"])))
    return pa.Table.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()), strict=True)],
        names=["f", "block", "inside", "depth", "in_array"],
    )


def _pieces(key: str):
    pattern = _pattern(key)

    def run(batches):
        at, state, number, held = None, State(), 0, []
        out: list[tuple] = []

        def batch():
            rows = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, names=["f", "block", "at", "begins", "ends", "text"])

        def close(ends: bool, begins: bool):
            nonlocal number
            out.append((*at, number, begins, ends, b"".join(held).decode()))
            number += 1
            held.clear()

        begun = False
        for f, block, part in _runs(batches):
            if at != (f, block):
                if held:
                    close(False, begun)
                first = part.slice(0, 1).to_pylist()[0]
                at, number = (f, block), 0
                state = State(first["inside"], first["depth"], first["in_array"])
                begun = False
            scan = Scan(part.column("value"), pattern)
            moves = scan.moves(state.inside)
            depth = state.depth + np.cumsum(moves)
            # the array that a place lies in: the last one opened at that depth
            lists = scan.lists(state.inside)
            wanted = np.zeros(len(depth), bool)
            wanted[lists] = True
            opened = np.flatnonzero((moves > 0) & (depth == ARRAY))
            which = np.searchsorted(opened, np.arange(len(depth)), side="right") - 1
            ours = np.append(wanted[opened], state.in_array)[which]  # -1: as the stretch began
            starts = np.flatnonzero((moves > 0) & (depth == ARRAY + 1) & (scan.data == OPEN_OBJECT) & ours)
            ends = np.flatnonzero((moves < 0) & (depth == ARRAY) & (scan.data == CLOSE_OBJECT) & ours) + 1
            within = state.in_array and state.depth > ARRAY
            begins_at = ([0] if within else []) + starts.tolist()
            ends_at = ends.tolist()
            data = scan.data.tobytes()
            for i, lo in enumerate(begins_at):
                if not (within and i == 0):
                    held.clear()
                    begun = True
                hi = ends_at[i] if i < len(ends_at) else len(data)
                held.append(data[lo:hi])
                if i < len(ends_at):
                    close(True, begun)
            state = State(state.inside ^ scan.flips, int(depth[-1]), bool(ours[-1]) and int(depth[-1]) >= ARRAY)
            if len(out) >= 1024 or sum(len(r[5]) for r in out) > 1 << 22:
                yield batch()
        if held:
            close(False, begun)
        if out:
            yield batch()

    return run


def read_elements(spark: SparkSession, path: str | list[str], key: str, schema: str) -> DataFrame:
    """``f, block, at, element``: the objects in the array ``key`` of each JSON object at a file's top level.

    UTF-8 files of one object over any number of lines, or of several objects one behind
    the other. The order of the elements is that of (file, ``block``, ``at``); ``f`` is a
    hash of the path. Other keys of the object, of any depth, are passed over, and an array
    of the same name deeper down too. An element that is not valid, or does not fit the
    schema, is NULL; those that are not objects are left out. The key must be written
    without escapes. A range is as large as ``spark.sql.files.maxPartitionBytes``; no task
    holds more than its batch and one element. Files are read twice and the elements
    that lie in several ranges are shuffled. Compressed files are one range each.
    """
    pin_splits(spark)
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    sums = lines.mapInArrow(_summed(key), SUMS)
    states = cut_lineage(sums.groupBy("f").applyInArrow(_folded, "f long, block long, inside int, depth long, in_array boolean"))
    # one row of a few numbers for each byte range
    side, _ = broadcast_if_small(states)
    pieces = cut_lineage(lines.join(side, ["f", "block"]).mapInArrow(_pieces(key), PIECES))

    here = F.col("begins") & F.col("ends")
    whole = pieces.where(here).select("f", "block", "at", "text")
    cut = pieces.where(~here)
    before = Window.partitionBy("f").orderBy("block", "at")
    first = F.last(F.when(F.col("begins"), F.struct("block", "at")), ignorenulls=True).over(before)
    # only the places of the pieces are ordered, without their texts
    owners = cut.select("f", "block", "at", first.alias("of"))
    stitched = (
        cut.join(owners, ["f", "block", "at"])
        .groupBy("f", "of")
        .agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("p"))
        .select("f", "of.block", "of.at", F.array_join("p.text", "").alias("text"))
    )
    return whole.unionByName(stitched).select("f", "block", "at", F.from_json("text", schema).alias("element"))
