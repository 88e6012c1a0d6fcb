"""How the sources of a language differ in the terms they use.

Each worker points at the word starts of its Arrow text buffers and sorts those
pointers by the text behind them (multikey quicksort on eight bytes at a time). Runs of
equal terms then give occurrences per source and documents per language. Only these
sums are shuffled; everything after the document frequency works on kept terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.words import Words, byte_class, strings, text_chunks
from spanloom.session import broadcast_if_small, cut_lineage

#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`
LETTERS = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
MIN_DOCUMENTS = 30
TOP = 50
UNIT = 1_000_000_000
PRIOR = 5

#: Pointers sorted together. A text with more of them is sorted in several slices.
SLICE = 1 << 21
#: Terms longer than this many 8-byte steps are compared as a whole from there on.
DEEP = 8
#: Bytes of text whose pointers are held at a time.
CHUNK_BYTES = 2 << 20
#: Rows that a worker gathers before it merges them, and sends them if merging frees too little.
GATHER = 400_000
#: Sources of a language whose differences a worker sums at a time, and the cells it holds.
TILE = 512
CELLS = 4 << 20


def _eight_bytes(data: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each term as a number that orders like them; 0 behind its end."""
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    key = np.ascontiguousarray(view[np.minimum(starts, len(view) - 1)]).view(">u8")[:, 0].astype(np.uint64)
    unused = np.uint64(8) * (8 - np.clip(left, 0, 8)).astype(np.uint64)
    # a shift by all 64 bits is undefined, hence two
    half = unused // np.uint64(2)
    return key >> half >> (unused - half) << half << (unused - half)


def sort_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the terms by their bytes, and where a run of equal terms begins in it.

    Equal terms stay in the order in which they were given. ``data`` goes on for eight
    bytes behind the last term.
    """
    sizes = ends - starts
    key = _eight_bytes(data, starts, sizes)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.empty(len(order), bool)
    new[:1] = True
    new[1:] = key[1:] != key[:-1]
    open_ = np.ones(len(order), bool)
    for depth in range(1, DEEP + 2):
        run = np.cumsum(new) - 1
        # runs of several terms of which one is longer than what was compared
        longer = np.zeros(run[-1] + 1 if len(run) else 0, bool)
        longer[run[open_ & (sizes[order] > 8 * depth)]] = True
        longer &= np.bincount(run, minlength=len(longer)) > 1
        at = np.flatnonzero(longer[run])
        if len(at) == 0:
            break
        mine, part = order[at], run[at]
        if depth <= DEEP:
            key = _eight_bytes(data, starts[mine] + 8 * depth, sizes[mine] - 8 * depth)
        else:
            rest = [data[s + 8 * depth : e].tobytes() for s, e in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)]
            rank = {b: i for i, b in enumerate(sorted(set(rest)))}
            key = np.array([rank[b] for b in rest], np.uint64)
        turn = np.lexsort((key, part))
        order[at] = mine[turn]
        key = key[turn]
        new[at[1:]] |= (key[1:] != key[:-1]) & (part[1:] == part[:-1])
        open_ = np.zeros(len(order), bool)
        open_[at] = True
    return order, new


def _merge(tables: list[pa.Table], documents: str = "sum") -> pa.Table:
    found = pa.concat_tables(tables).group_by(["g", "term"]).aggregate([("n", "sum"), ("df", documents)])
    return pa.table({"g": found["g"], "term": found["term"], "n": found["n_sum"], "df": found[f"df_{documents}"]})


def term_runs(texts: pa.Array, group: np.ndarray, size: int = SLICE) -> pa.Table:
    """Occurrences ``n`` and documents ``df`` of each term in each group of an array of whole texts."""
    words = Words(texts, LETTERS, lower=True)
    data = np.concatenate([words.data, np.zeros(8, np.uint8)])
    # pointers by group, then text: equal terms stay in that order
    by_group = np.argsort(group, kind="stable")
    counts = words.counts[by_group]
    owner = np.repeat(np.arange(len(by_group)), counts)
    pointer = np.repeat(words.first[by_group] - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))
    step = size if len(texts) == 1 else max(len(owner), 1)
    found = []
    for at in range(0, max(len(owner), 1), step):
        mine, of = pointer[at : at + step], owner[at : at + step]
        starts, ends = words.starts[mine], words.ends[mine]
        order, new = sort_pointers(data, starts, ends)
        g, doc = group[by_group[of[order]]], of[order]
        if len(new):
            new_doc = new.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            new[1:] |= g[1:] != g[:-1]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(order)))
        df = np.add.reduceat(new_doc.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        begin, end = starts[order[first]], ends[order[first]]
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum(end - begin, out=offsets[1:])
        spread = np.repeat(begin - offsets[:-1], end - begin) + np.arange(offsets[-1])
        found.append(pa.table({"g": pa.array(g[first], pa.int32()), "term": strings(data[spread], offsets), "n": n, "df": df}))
    # the slices of one text: it is one document in all of them
    return found[0] if len(found) == 1 else _merge(found, "max")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, source = (pa.array([k[i] for k in numbers], pa.string()) for i in (0, 1))
        out = pa.table(
            {
                "lang": pc.take(lang, table["g"]),
                "source": pc.take(source, table["g"]),
                "term": table["term"].cast(pa.string()),
                "n": table["n"],
                "df": table["df"],
            }
        )
        yield from out.to_batches(max_chunksize=65_536)

    for batch, texts in text_chunks(batches, CHUNK_BYTES):
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        group = np.array([numbers.setdefault(p, len(numbers)) for p in pairs], np.int32)
        held.append(term_runs(texts, group))
        if sum(t.num_rows for t in held) > GATHER:
            held = [_merge(held)]
            if held[0].num_rows > GATHER // 2:
                yield from rows(held.pop())
    if held:
        yield from rows(_merge(held))


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def term_counts(docs: DataFrame, text: str, lang: str, source: str, min_documents: int) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``: the terms in at least so many documents of their language."""
    rows = docs.select(_text(lang).alias("lang"), _text(source).alias("source"), _text(text).alias("text"))
    sums = rows.mapInArrow(_count, "lang string, source string, term string, n long, df long")
    # one shuffle serves both sums: a term's rows are at most (tasks x sources). Both read all its
    # columns, for which the last two conditions stand (they always hold): else they are two shuffles
    dealt = sums.repartition("lang", "term")
    kept = dealt.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.count("source").alias("rows"))
    kept = kept.where((F.col("df") >= min_documents) & (F.col("n") > 0) & (F.col("rows") > 0))
    counts = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where("df > 0")
    return counts.join(kept.select("lang", "term").hint("shuffle_hash"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")


def _share(n: str, total: str, v: str) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * v)), exact."""
    return F.expr(
        f"1L + (cast({UNIT} as decimal(10,0)) * cast({n} + {PRIOR} as decimal(20,0)))"
        f" div cast({total} + {PRIOR} * {v} as decimal(20,0))"
    )


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over terms of |p of a - p of b| for the sources a of a tile."""
    held: dict[tuple[str, int], np.ndarray] = {}

    def rows():
        for (lang, tile), total in held.items():
            size = total.shape[1]
            for at in range(0, len(total), max(1, CELLS // size)):
                part = total[at : at + max(1, CELLS // size)]
                d = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, size), pa.int32()), pa.array(part.ravel()))
                a = pa.array(np.arange(len(part)) + tile * TILE + at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), a, d], names=["lang", "a", "d"])
        held.clear()

    for batch in batches:
        langs, tiles = np.array(batch.column("lang").to_pylist(), object), batch.column("tile").to_numpy()
        for lang, tile in sorted(set(zip(langs.tolist(), tiles.tolist(), strict=True))):
            mine = batch.filter(pa.array((langs == lang) & (tiles == tile)))
            zeros = mine.column("zeros")[0].values.to_numpy()
            width, first = len(zeros), tile * TILE
            step = max(1, CELLS // width)
            for at in range(0, mine.num_rows, step):
                cells = mine.column("cells").slice(at, step)
                flat = cells.flatten()
                p = np.tile(zeros, (len(cells), 1))
                row = np.repeat(np.arange(len(cells)), pc.list_value_length(cells).to_numpy())
                p[row, flat.field("at").to_numpy()] = flat.field("p").to_numpy()
                total = held.setdefault((lang, tile), np.zeros((min(TILE, width - first), width), np.int64))
                for a in range(len(total)):
                    total[a] += np.abs(p - p[:, first + a : first + a + 1]).sum(axis=0)
            if sum(t.size for t in held.values()) > CELLS:
                yield from rows()
    yield from rows()


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top: int = TOP,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` of every (language, source) group.

    A NULL text, language or source counts as ''. Part ``pair`` has every other source of
    the language by how far the term shares lie apart; part ``term`` the terms that the
    group uses more than its language, at most ``top``. Ties go by the item's bytes. A
    language whose terms are all too rare has pairs of value 0 and no terms; a language
    of one source has no pairs; an empty table gives no rows. Repeated rows are documents
    of their own. Texts are read whole; other columns are not looked at. The pairs of a
    language are (sources x sources) rows, as asked for.
    """
    counts = cut_lineage(term_counts(docs, text, lang, source, min_documents))
    by_term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("lang_n", F.sum("n").over(by_term))
    groups = docs.select(_text(lang).alias("lang"), _text(source).alias("source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = (
        counts.groupBy("lang", "term")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("v"))
    )
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    book = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    book = cut_lineage(book.na.fill(0, ["total", "lang_total", "v"]).withColumn("at", number))
    small, _ = broadcast_if_small(book)
    cells = counts.join(small, ["lang", "source"]).select(
        "lang", "source", "term", "at", _share("n", "total", "v").alias("p"), _share("lang_n", "lang_total", "v").alias("q")
    )

    zeros = (
        book.where("v > 0")
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("at", _share("0L", "total", "v").alias("p")))).alias("zeros"))
        .select("lang", F.col("zeros.p").alias("zeros"))
    )
    zeros, _ = broadcast_if_small(cut_lineage(zeros))
    terms = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p")).alias("cells")).join(zeros, "lang")
    tiles = terms.select(
        "lang", "cells", "zeros", F.explode(F.sequence(F.lit(0), ((F.size("zeros") - 1) / TILE).cast("int"))).alias("tile")
    )
    apart = tiles.mapInArrow(_differences, "lang string, a int, d array<long>")
    apart = apart.select("lang", F.col("a").alias("at"), F.posexplode("d").alias("b", "d"))
    apart = apart.groupBy("lang", "at", "b").agg(F.sum("d").alias("d"))

    other = small.select("lang", F.col("source").alias("item"), F.col("at").alias("b"))
    pairs = book.select("lang", "source", "at").join(other, "lang").where("at <> b").join(apart, ["lang", "at", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("d", F.lit(0).cast("long")).alias("value"))
    words = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return pairs.withColumn("rank", rank).unionByName(words.withColumn("rank", rank).where(F.col("rank") <= top))
