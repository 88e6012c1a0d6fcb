"""SimHash near-duplicates (method: vantage-point trees over Hamming space).

Fingerprints are made once per whole text and reduced to distinct values. A tree
of vantage points, fitted on a bounded sample of them, cuts the space into shards
by distance. Each fingerprint has one home shard; where the triangle inequality
cannot rule out a partner beyond a boundary, it also visits the shard there. Each
shard searches its own tree exactly and returns a spanning forest of its links, so
the output grows with the fingerprints and not with the pairs. The forests' union
has the same components as all links.

Defined cases: a null or empty text has the fingerprint zero and links like any
other; a text shorter than a shingle is one shingle; repeated rows share a
fingerprint; an empty table gives no rows; further columns are not looked at.
A null document id never becomes a component's id unless it has no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.components import components
from spanloom.llm.words import SPACED, Words, measure
from spanloom.session import cut_lineage

SHINGLE = 3
RADIUS = 2
#: Bytes of text whose shingles a worker holds at once.
HASHED_BYTES = 4 << 20
#: Bound of the sample that places the vantage points (8 bytes each on the driver).
SAMPLE = 1 << 16
#: Fingerprints aimed at in a shard, and the fewest sampled ones that a cut needs.
SHARD = 8192
CUT_SAMPLE = 32
#: Within a shard, sets up to this size are compared directly.
DIRECT = 512


def shingle_bounds(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and last word + 1 of each shingle, and the shingles of each text."""
    n = np.where(words.counts > 0, np.maximum(words.counts - width + 1, 1), 0)
    base = np.repeat(words.first[:-1] - np.cumsum(n) + n, n)
    begin = base + np.arange(n.sum())
    return begin, np.minimum(begin + width, np.repeat(words.first[1:], n)), n


def joined_words(words: Words) -> tuple[bytes, np.ndarray]:
    """All words with one space behind each, and where each word begins."""
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words.ends - words.starts + 1, out=begin[1:])
    out = np.full(begin[-1], 0x20, np.uint8)
    place = np.ones(len(out), bool)
    place[begin[1:] - 1] = False
    out[place] = words.data[words.inside]
    return out.tobytes(), begin


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per run of ``counts`` hashes, the 64 bits that are set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    parts = -(-n // 255)  # a byte holds the count of one part
    first_part = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(n) - n, parts) + 255 * (
        np.arange(parts.sum()) - np.repeat(first_part, parts)
    )
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, begin)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first_part)
        for byte in range(8):
            over = (2 * ones[:, byte] > n).astype(np.uint64)
            out[full] |= over << np.uint64(8 * byte + bit)
    return out


def fingerprints(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text as a signed 64-bit integer."""
    import xxhash

    words = Words(texts, SPACED, lower=True)
    begin, end, n = shingle_bounds(words, width)
    raw, at = joined_words(words)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], 42) for a, b in zip(at[begin].tolist(), (at[end] - 1).tolist())),
        np.uint64,
        len(begin),
    )
    return majority(hashes, n).view(np.int64)


def with_fingerprints(docs: DataFrame, keep: list[str], width: int = SHINGLE, text: str = "text") -> DataFrame:
    """The kept columns and ``fp``."""
    field = T.StructField("fp", T.LongType())
    return measure(
        docs, lambda t: [fingerprints(t, width)], [field], keep, text, HASHED_BYTES
    ).select("row.*", "fp")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; unsigned, as bits of a negative number are those of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


class Forest:
    """Links of one shard, kept as a forest over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.up[at]
        while True:
            above = self.up[up]
            if np.array_equal(above, up):
                return up
            up = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            # each larger root takes one smaller root; what is left goes round again
            self.up[np.maximum(ra, rb)] = np.minimum(ra, rb)


def _direct(points, a, b, radius, forest) -> None:
    for start in range(0, len(a), DIRECT):
        rows = a[start : start + DIRECT]
        for at in range(0, len(b), 2048):
            cols = b[at : at + 2048]
            i, j = np.nonzero(distances(points[rows][:, None], points[cols][None, :]) <= radius)
            if len(i):
                forest.link(rows[i], cols[j])


def _across(points, a, b, radius, forest, seed=1) -> None:
    """All links between the sets ``a`` and ``b`` of positions."""
    if not len(a) or not len(b):
        return
    if min(len(a), len(b)) <= DIRECT:
        return _direct(points, a, b, radius, forest)
    longer = a if len(a) >= len(b) else b
    vantage = points[longer[(seed * 7919) % len(longer)]]
    da, db = distances(points[a], vantage).astype(int), distances(points[b], vantage).astype(int)
    mid = int(np.median(np.concatenate([da, db])))
    cuts = [(a[da <= mid], b[db <= mid + radius]), (a[da > mid], b[db > mid - radius])]
    if sum(len(x) * len(y) for x, y in cuts) > 0.9 * len(a) * len(b):
        return _direct(points, a, b, radius, forest)
    for x, y in cuts:
        _across(points, x, y, radius, forest, seed + 1)


def _within(points, a, radius, forest, seed=1) -> None:
    """All links inside the set ``a`` of positions."""
    if len(a) <= DIRECT:
        return _direct(points, a, a, radius, forest)
    vantage = points[a[(seed * 7919) % len(a)]]
    d = distances(points[a], vantage).astype(int)
    mid = int(np.median(d))
    inner, outer = d <= mid, d > mid
    if not outer.any():
        mid -= 1
        inner, outer = d <= mid, d > mid
    if not inner.any() or not outer.any():
        return _direct(points, a, a, radius, forest)
    _within(points, a[inner], radius, forest, seed + 1)
    _within(points, a[outer], radius, forest, seed + 1)
    _across(points, a[inner & (d > mid - radius)], a[outer & (d <= mid + radius)], radius, forest, seed + 1)


def shard_links(home: np.ndarray, visiting: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``home`` and between ``home`` and ``visiting``."""
    points = np.concatenate([home, visiting])
    forest = Forest(len(points))
    at = np.arange(len(points))
    _within(points, at[: len(home)], radius, forest)
    _across(points, at[: len(home)], at[len(home) :], radius, forest)
    root = forest.roots(at)
    joined = root != at
    return points[joined], points[root[joined]]


def vantage_tree(sample: np.ndarray, leaves: int) -> dict[str, np.ndarray]:
    """Vantage points and radii of an inner node each; a child below zero is leaf ``-1 - child``.

    Cut where the sample of a node is largest, until there are ``leaves`` shards or
    the samples are too small or cannot be cut.
    """
    import heapq

    vantage, mids, inside, outside, n_leaves = [], [], [], [], 0
    rng = np.random.default_rng(5)
    heap = [(-len(sample), 0, sample, None)]
    order, waiting = 1, []
    while heap:
        size, _, points, slot = heapq.heappop(heap)
        node = None
        if len(heap) + len(waiting) + 1 < leaves and -size >= 2 * CUT_SAMPLE:
            best = None
            for v in points[rng.integers(0, len(points), 8)]:
                d = distances(points, v).astype(int)
                mid = int(np.median(d))
                band = ((d > mid - RADIUS) & (d <= mid + RADIUS)).mean()
                inner = (d <= mid).mean()
                if 0.1 <= inner <= 0.9 and band < 0.95 and (best is None or band < best[0]):
                    best = (band, v, mid, d)
            if best:
                _, v, mid, d = best
                node = len(vantage)
                vantage.append(v), mids.append(mid), inside.append(0), outside.append(0)
                for child, side in ((points[d <= mid], inside), (points[d > mid], outside)):
                    heapq.heappush(heap, (-len(child), order, child, (side, node)))
                    order += 1
        if node is None:
            waiting.append(slot)
            node = -1 - n_leaves
            n_leaves += 1
        if slot:
            slot[0][slot[1]] = node
    return {
        "vantage": np.array(vantage, np.int64),
        "mid": np.array(mids, np.int64),
        "inside": np.array(inside, np.int64),
        "outside": np.array(outside, np.int64),
    }


def route(fp: np.ndarray, tree: dict[str, np.ndarray], radius: int = RADIUS):
    """(shard, fingerprint, visits) rows: each fingerprint at home once, and where it must visit."""
    node = np.full(len(fp), 0 if len(tree["vantage"]) else -1)
    visit = np.zeros(len(fp), bool)
    done = []
    while True:
        leaf = node < 0
        done.append((-1 - node[leaf], fp[leaf], visit[leaf]))
        fp, node, visit = fp[~leaf], node[~leaf], visit[~leaf]
        if not len(fp):
            return tuple(np.concatenate(x) for x in zip(*done))
        d = distances(fp, tree["vantage"][node]).astype(np.int64)
        mid = tree["mid"][node]
        home_in, home_out = ~visit & (d <= mid), ~visit & (d > mid)
        # a pair across the boundary meets inside, where its outer member visits
        visit_in = (d <= mid + radius) & (visit | home_out)
        visit_out = (d > mid - radius) & visit
        inside, outside = tree["inside"][node], tree["outside"][node]
        node = np.concatenate([inside[home_in], outside[home_out], inside[visit_in], outside[visit_out]])
        visits = [np.zeros(home_in.sum() + home_out.sum(), bool), np.ones(visit_in.sum() + visit_out.sum(), bool)]
        fp = np.concatenate([fp[home_in], fp[home_out], fp[visit_in], fp[visit_out]])
        visit = np.concatenate(visits)


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``a``, ``b``: a forest whose components are those of all links among distinct ``fp``."""
    spark = distinct.sparkSession
    n = distinct.count()
    share = min(1.0, sample / max(n, 1))
    cut = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))
    seen = np.array([r.fp for r in distinct.where(cut).select("fp").toLocalIterator()], np.int64)
    tree = spark.sparkContext.broadcast(vantage_tree(np.sort(seen), max(1, -(-n // shard))))

    def send(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for start in range(0, len(fp), 1 << 14):
                parts = route(fp[start : start + (1 << 14)], tree.value, radius)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["shard", "fp", "visits"])

    def search(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        visits = table.column("visits").to_numpy(zero_copy_only=False)
        a, b = shard_links(fp[~visits], fp[visits], radius)
        return pa.table({"a": a, "b": b})

    sent = distinct.select("fp").mapInArrow(send, "shard long, fp long, visits boolean")
    return sent.groupBy("shard").applyInArrow(search, "a long, b long")


def classes(prints: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``fp`` and ``component_id``, the smallest document id reachable over links of fingerprints."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min(doc_id).alias("least")))
    found = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    labelled = distinct.join(found, "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return labelled.join(smallest, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", width: int = SHINGLE, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, one row per document."""
    prints = cut_lineage(with_fingerprints(docs, [doc_id], width, text))
    return prints.join(classes(prints, doc_id, radius), "fp").select(doc_id, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that with the smallest id; columns unchanged.

    Of rows that share this id, the one with the smallest hash of its text stays.
    """
    return keep_least(docs, near_duplicates(docs, doc_id, text=text), doc_id, text)


def keep_least(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows whose id is the ``component_id`` that ``found`` gives it, one of each id."""
    kept = found.where(F.col(doc_id).eqNullSafe(F.col("component_id")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(doc_id).alias("key")
    )
    # The kept ids grow with the documents, so the join is never planned as a broadcast.
    ids = kept.select(_key(doc_id).alias("key")).distinct().hint("merge")
    place = Window.partitionBy("key").orderBy(F.xxhash64(F.col(f"row.`{text}`")))
    return (
        rows.join(ids, "key", "left_semi")
        .withColumn("place", F.row_number().over(place))
        .where("place = 1")
        .select("row.*")
    )


def _key(doc_id: str) -> Column:
    """The id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{doc_id}`").cast("string")), F.lit(""))
