"""Substring deduplication (method: count-min prefilter, then exact grouping).

A window is ``width`` neighbouring words of one document. Its anchor is the leftmost
least hash among the half as long shingles inside it, so equal windows have equal
anchors at equal places, and a window repeats at most as often as its anchor. Every
partition counts its anchors in a sparse count-min sketch; the merged sketches
overestimate the counts of anchors, and with them those of windows. A second pass
sends only windows whose estimate says "repeated", grouped by anchor, and compares
them exactly (anchor and window hash, 64 bits each). No repeated window is lost.

Windows of one anchor travel as one row, and a chunk of documents sends a window
once, so a passage found everywhere has few rows per partition. The sketch has
about eight cells per anchor and at most ``MAX_CELLS``; a corpus beyond that only
sends more windows to the exact pass.

Defined cases: a null or empty text has no words; a text shorter than a window keeps
all its words; of equal windows the first by (document id, start) stays, a null id
coming first; ids that are no whole numbers are ordered as text, by its bytes; rows that
share an id are taken as one document, each read with the repeats found in any of them,
so they should share a text; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.words import SPACED, Words, strings, text_chunks, word_hashes

WIDTH = 20
#: Cells of a slice of the sketch, and of the whole sketch at most (an eighth of it in bytes is broadcast).
SLICE_CELLS = 1 << 22
MAX_CELLS = 1 << 31
#: Cells that a task holds before it passes them on.
HELD_CELLS = 1 << 22
FIRST_ID = -(1 << 63)

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Per width, a hash of every run of that many neighbouring values."""
    n = len(values)
    powers = np.full(n, _STEP)
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    back = np.full(n, _BACK)
    back[:1] = 1
    back = np.multiply.accumulate(back)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers, out=sums[1:])
    return [mixed((sums[w:] - sums[:-w]) * back[: n - w + 1]) if n >= w else values[:0] for w in widths]


def leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost least of each ``span`` neighbouring values."""
    at = np.arange(len(values))
    size = 1

    def join(at, step):
        left, right = at[: len(at) - step], at[step:]
        return np.where(values[right] < values[left], right, left)

    while 2 * size <= span:
        at = join(at, size)
        size *= 2
    return join(at, span - size) if span > size else at


class Windows:
    """Windows of a chunk: ``start`` word, ``hash``, ``anchor`` position; ``anchor_hash`` by position."""

    def __init__(self, texts: pa.Array, width: int):
        self.words = words = Words(texts, SPACED)
        distinct, codes = words.codes()
        hashes = word_hashes(distinct, 42)[codes] if len(codes) else np.zeros(0, np.uint64)
        half = max(1, width // 2)
        self.anchor_hash, whole = rolling(hashes, (half, width))
        owner = words.owner
        n = len(whole)
        self.start = np.flatnonzero(owner[:n] == owner[width - 1 :]) if n else np.zeros(0, np.int64)
        self.hash = whole[self.start]
        self.anchor = leftmost_least(self.anchor_hash, width - half + 1)[self.start] if n else self.start


def cells_of(anchors: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash in the sketch's two rows, the lower and the upper half of it."""
    half = np.uint64(cells // 2)
    low = anchors & np.uint64(0xFFFFFFFF)
    return (low % half).astype(np.int64), ((anchors >> np.uint64(32)) % half + half).astype(np.int64)


def _counts(batches, width: int, cells: int):
    """Sparse sketches of the batches, by slice: cells seen once, and cells seen more often."""
    held, size = [], 0

    def flush():
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        part = cell // SLICE_CELLS
        bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        rows = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            inside, many = (cell[a:b] % SLICE_CELLS).astype(np.int32), n[a:b] > 1
            # differences of sorted cells are small and compress well
            packed = [np.diff(x, prepend=np.int32(0)).tobytes() for x in (inside[~many], inside[many])]
            rows.append((int(part[a]), *packed))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
            ["slice", "once", "more"],
        )

    for _, texts in text_chunks(batches):
        windows = Windows(texts, width)
        anchors = windows.anchor_hash[np.unique(windows.anchor)]
        held += cells_of(anchors, cells)
        size += 2 * len(anchors)
        if size > HELD_CELLS:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _merge(table: pa.Table) -> pa.Table:
    """Adds the sparse sketches of one slice; a bit per cell says whether the sum exceeds one."""
    count = np.zeros(SLICE_CELLS, np.uint8)
    for column, weight in (("once", 1), ("more", 2)):
        for packed in table.column(column).to_pylist():
            at = np.cumsum(np.frombuffer(packed, np.int32), dtype=np.int64)
            count[at] = np.minimum(count[at] + weight, 2)
    bits = np.packbits(count > 1, bitorder="little").tobytes()
    return pa.table({"slice": table.column("slice").slice(0, 1), "bits": pa.array([bits], pa.binary())})


def sketch(docs: DataFrame, width: int = WIDTH, text: str = "text", max_cells: int = MAX_CELLS) -> tuple[int, np.ndarray]:
    """Number of cells, and for each a bit: its merged count is two or more."""
    rows = docs.select(F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word has some six bytes, and about one anchor falls on a quarter of a window
    anchors = max(1, size * 4 // (6 * width))
    cells = min(max_cells, max(1 << 10, 1 << (8 * anchors - 1).bit_length()))
    merged = (
        rows.mapInArrow(lambda it: _counts(it, width, cells), "slice long, once binary, more binary")
        .groupBy("slice")
        .applyInArrow(_merge, "slice long, bits binary")
    )
    bits = np.zeros(max(cells, SLICE_CELLS) // 8, np.uint8)
    for row in merged.toLocalIterator():  # one row of SLICE_CELLS / 8 bytes per slice
        at = row["slice"] * (SLICE_CELLS // 8)
        bits[at : at + SLICE_CELLS // 8] = np.frombuffer(row["bits"], np.uint8)
    return cells, bits[: max(1, cells // 8)]


def _candidates(batch: pa.RecordBatch, texts: pa.Array, width: int, cells: int, bits: np.ndarray) -> pa.RecordBatch:
    """Rows of windows of one anchor that may repeat: those first in the chunk with their hashes."""
    named = batch.column("id")
    if pa.types.is_integer(named.type):
        ids = named.to_numpy()
    else:  # the places of text ids in the order of their bytes
        coded = named.dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        ids = place[coded.indices.to_numpy()]
    order = np.argsort(ids, kind="stable")
    ids, named = ids[order], named.take(pa.array(order))
    windows = Windows(texts.take(pa.array(order)), width)
    words = windows.words
    places, at = np.unique(windows.anchor, return_inverse=True)
    anchors = windows.anchor_hash[places]
    seen = np.ones(len(places), bool)
    for cell in cells_of(anchors, cells):
        seen &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
    kept = np.flatnonzero(seen[at])
    start, value, group = windows.start[kept], windows.hash[kept], at[kept]
    doc = np.searchsorted(words.first, start, side="right") - 1
    inner = start - words.first[doc]
    # windows stand in the order of (id, start); the sort keeps it among equals
    by_hash = np.argsort(value, kind="stable")
    new = np.ones(len(kept), bool)
    a, b = by_hash[:-1], by_hash[1:]
    new[1:] = (value[a] != value[b]) | (anchors[group[a]] != anchors[group[b]])
    head = by_hash[np.maximum.accumulate(np.where(new, np.arange(len(kept)), 0))]
    again = np.zeros(len(kept), bool)  # beginning earlier in this chunk
    again[by_hash] = (ids[doc[head]] != ids[doc[by_hash]]) | (inner[head] != inner[by_hash])
    first = np.zeros(len(kept), bool)
    first[by_hash] = new
    run = np.ones(len(kept), bool)
    run[1:] = (np.diff(start) != 1) | (np.diff(group) != 0)
    begin = np.flatnonzero(run)
    row = np.cumsum(run) - 1
    offset = np.arange(len(kept)) - begin[row] if len(kept) else row
    mask = np.bincount(row, weights=again * 2.0**offset, minlength=len(begin)).astype(np.int64)
    sent = np.bincount(row, weights=first, minlength=len(begin)).astype(np.int64)
    key = anchors[group[begin]].view(np.int64).copy()
    own = mixed(ids[doc[begin]].astype(np.uint64) * _STEP + inner[begin].astype(np.uint64)).view(np.int64)
    key[sent == 0] = own[sent == 0]  # nothing to compare: spread instead of meeting at the anchor
    bounds = np.concatenate([[0], np.cumsum(sent)]).astype(np.int32)
    pair = pa.StructArray.from_arrays(
        [pa.array(offset[first].astype(np.int8)), pa.array(value[first].view(np.int64))], ["k", "h"]
    )
    columns = [
        pa.array(key),
        named.take(pa.array(doc[begin])),
        pa.array(inner[begin].astype(np.int32)),
        pa.array(mask.astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(bounds), pair),
    ]
    some = (mask > 0) | (sent > 0)
    return pa.RecordBatch.from_arrays(columns, ["anchor", "id", "start", "mask", "windows"]).filter(pa.array(some))


_ROW = "anchor long, id {kind}, start int, mask int, windows array<struct<k:tinyint,h:long>>"


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, max_cells: int = MAX_CELLS) -> DataFrame:
    """``id``, ``start`` and ``mask``: bit k set if the window at start + k also starts earlier."""
    spark = docs.sparkSession
    cells, bits = sketch(docs, width, text, max_cells)
    shared = spark.sparkContext.broadcast(bits)
    rows = docs.select(_id(docs, doc_id).alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for batch, texts in text_chunks(batches):
            yield _candidates(batch, texts, width, cells, shared.value)

    sent = rows.mapInArrow(run, _ROW.format(kind=rows.schema["id"].dataType.simpleString())).repartition("anchor")
    each = sent.select("anchor", "id", "start", "mask", F.inline_outer("windows"))
    here = F.struct("id", (F.col("start") + F.col("k")).alias("at"))
    least = F.min(here).over(Window.partitionBy("anchor", "h"))
    bit = F.when(F.col("h").isNotNull() & (here != least), F.expr("shiftleft(1, cast(k as int))")).otherwise(0)
    return (
        each.select("anchor", "id", "start", F.col("mask").bitwiseOR(bit).alias("mask"))
        .groupBy("anchor", "id", "start")
        .agg(F.bit_or("mask").alias("mask"))
        .where("mask != 0")
        .select("id", "start", "mask")
    )


def _id(docs: DataFrame, doc_id: str):
    """The id as a whole number or a text that orders like it, NULL first."""
    column = F.col(f"`{doc_id}`")
    if isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        return F.coalesce(column.cast("long"), F.lit(FIRST_ID))
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))


def _strip(texts: pa.Array, flags: pa.Array, width: int) -> list:
    """Words, removed words and the kept words joined by one space, of each text."""
    words = Words(texts, SPACED)
    lists = pc.fill_null(pc.list_value_length(flags), 0).to_numpy(zero_copy_only=False)
    flat = flags.flatten()
    start = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    mask = flat.field("mask").to_numpy(zero_copy_only=False).astype(np.int64)
    begin = start + np.repeat(words.first[:-1], lists)
    cover = np.zeros(len(words) + 1, np.int64)
    for k in range(width):
        at = begin[(mask >> k) & 1 > 0] + k
        np.add.at(cover, at, 1)
        np.add.at(cover, at + width, -1)
    gone = np.cumsum(cover[:-1]) > 0
    removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
    keep = ~gone
    owner = words.owner[keep]
    size = (words.ends - words.starts)[keep] + 1
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    # the words with a space behind each but the last of a text
    out_at = np.concatenate([[0], np.cumsum(size - last)])
    out = np.full(out_at[-1], 0x20, np.uint8)
    chosen = np.zeros(len(words.data) + 1, np.int8)
    chosen[words.starts[keep]] += 1
    np.add.at(chosen, words.ends[keep], -1)
    chosen = np.cumsum(chosen[:-1], dtype=np.int8) > 0
    place = np.ones(len(out), bool)
    place[(out_at[1:] - 1)[~last]] = False
    out[place] = words.data[chosen]
    text_at = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [words.counts, np.diff(removed), strings(out, out_at[text_at]).cast(pa.string())]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, keep: list[str] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """``row``, ``n_words``, ``n_removed`` and ``kept``, the text without repeated windows."""
    flags = (
        repeated(docs, doc_id, text, width, max_cells)
        .groupBy("id")
        .agg(F.collect_list(F.struct("start", "mask")).alias("flags"))
    )
    names = docs.columns if keep is None else keep
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"), _id(docs, doc_id).alias("id")
    ).join(flags, "id", "left")
    rows = rows.select("row", "text", "flags")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]

    def run(batches):
        for batch, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *[x if isinstance(x, pa.Array) else pa.array(x) for x in _strip(texts, batch.column("flags"), width)]],
                ["row", *[f.name for f in fields]],
            )

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *fields]))
