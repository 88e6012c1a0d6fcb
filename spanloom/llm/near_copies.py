"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Method: SimHash fingerprints of the sets, searched by vantage-point trees (``simhash``).
Documents with equal sets are one node. Fingerprints that differ in at most ``RADIUS`` bits
are linked by the trees, and each of these links is checked on the sets (of 32-bit
hashes). At a similarity of 0.8 fingerprints differ in some 10 of 64 bits, and at that
radius the trees rule out nothing, so what lies beyond ``RADIUS`` is found behind them:
documents meet where a band of their minimum hashes agrees; a link of similarity 0.8 is
missed by all ``BANDS`` bands about three times in a million, a closer one less often. In bands that the
trees left in several components each member is checked against the band's first member, then, in bands that
this left in several components, all pairs between components, in blocks of so many
members and set elements.

Defined cases: null and empty texts have the empty set and are copies of one another;
a text shorter than a shingle is one shingle; letters A-Z count as lower case; an
empty table gives no rows. A null document id never becomes a component's id unless
it has no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm import simhash
from spanloom.llm.components import components
from spanloom.llm.words import SPACED, Words, measure
from spanloom.session import cut_lineage

SHINGLE = 5
SIMILAR = 0.8
#: Differing bits up to which the vantage-point trees link fingerprints.
RADIUS = 3
#: Bands of minimum hashes, and the hashes that must agree in one.
BANDS, ROWS = 24, 4
#: Members of a band that are compared at once with as many others, and the elements of their sets on average.
BLOCK, BLOCK_ELEMENTS = 256, 1 << 21
#: Bytes of text whose shingles a worker holds at once.
HASHED_BYTES = 1 << 20

_SEEDS = np.random.default_rng(17).integers(0, 1 << 64, (BANDS * ROWS, 2), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and how many each text has."""
    import xxhash

    words = Words(texts, SPACED, lower=True)
    begin, end, n = simhash.shingle_bounds(words, width)
    raw, at = simhash.joined_words(words)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], 42) for a, b in zip(at[begin].tolist(), (at[end] - 1).tolist())), np.uint64, len(begin)
    )
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], np.bincount(owner[first], minlength=len(n))


def prints(texts: pa.Array, width: int = SHINGLE) -> list:
    """Of each text: a key of its set, its SimHash fingerprint, the band keys (none for the empty set), and 32 bits of each hash."""
    hashes, n = shingle_sets(texts, width)
    key = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    bands = np.zeros((len(full), BANDS), np.uint64)
    if len(full):
        begin = (np.cumsum(n) - n)[full]
        key[full] = _mixed(np.add.reduceat(_mixed(hashes), begin) + n[full].astype(np.uint64))
        for k, (mask, factor) in enumerate(_SEEDS):
            least = np.minimum.reduceat((hashes ^ mask) * (factor | np.uint64(1)), begin)
            band = bands[:, k // ROWS]
            band[:] = _mixed(band + _mixed(least + np.uint64(k)))
    offsets = np.zeros(len(n) + 1, np.int32)
    offsets[1:] = np.cumsum(np.where(n > 0, BANDS, 0))
    # the upper halves are in order too
    upper = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
    owner = np.repeat(np.arange(len(n)), n)
    first = np.ones(len(upper), bool)
    first[1:] = (upper[1:] != upper[:-1]) | (owner[1:] != owner[:-1])
    ends = np.zeros(len(n) + 1, np.int32)
    np.cumsum(np.bincount(owner[first], minlength=len(n)), out=ends[1:])
    return [
        pa.array(key.view(np.int64)),
        pa.array(simhash.majority(hashes, n).view(np.int64)),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1).view(np.int64))),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(upper[first])),
    ]


def similar(shared, a, b):
    """Whether sets of ``a`` and ``b`` elements with ``shared`` common ones reach 0.8, in whole numbers."""
    return 5 * shared >= 4 * (a + b - shared)


def _check_blocks(table: pa.Table) -> pa.Table:
    """All similar pairs of a block, or between two blocks, that are in different components."""
    key = table.column("key").to_numpy()
    part = table.column("part").to_numpy()
    side = table.column("block").to_numpy()
    sets = table.column("set").combine_chunks()
    n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
    begin = np.cumsum(n) - n
    flag = np.zeros(codes.max() + 1, np.uint8)
    low = side == side.min()
    across = not low.all()
    out_a, out_b = [], []
    for i in np.flatnonzero(low):
        own = codes[begin[i] : begin[i] + n[i]]
        flag[own] = 1
        shared = np.add.reduceat(flag[codes], begin, dtype=np.int64)
        flag[own] = 0
        hit = np.flatnonzero(similar(shared, n, n[i]) & (part != part[i]) & (~low if across else True))
        out_a.append(np.full(len(hit), key[i])), out_b.append(key[hit])
    return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def tree_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: distinct keys whose fingerprints the vantage-point trees link, or that share a fingerprint.

    Of keys with one fingerprint the smallest stands for it.
    """
    first = cut_lineage(nodes.groupBy("fp").agg(F.min("key").alias("hub")))
    near = simhash.links(first.select("fp"), radius).withColumnsRenamed({"a": "fa", "b": "fb"})
    ends = [first.select(F.col("fp").alias(f"f{x}"), F.col("hub").alias(x)).hint("merge") for x in "ab"]
    linked = near.join(ends[0], "fa").join(ends[1], "fb").select("a", "b")
    same = nodes.join(first.hint("merge"), "fp").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    return cut_lineage(linked.union(same).distinct())


def links(nodes: DataFrame, sets: DataFrame, block: int = BLOCK, elements: int = BLOCK_ELEMENTS, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: similar pairs whose components are those of all similar pairs that share a band.

    ``nodes`` has distinct ``key``, ``fp`` and ``bands``, ``sets`` distinct ``key`` and ``set``.
    """
    trees = tree_pairs(nodes, radius)
    banded = nodes.select("key", F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("hub"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("sum")
    ).where("n > 1")
    # bands with the same members are looked at once
    groups = groups.groupBy("n", "hub", "sum").agg(F.min("band").alias("band")).select("band", "n", "hub")
    members = cut_lineage(banded.join(groups.hint("merge"), "band"))
    wanted = members.select("key").union(trees.select("a")).union(trees.select("b")).distinct()
    sets = cut_lineage(sets.join(wanted.hint("merge"), "key", "left_semi").dropDuplicates(["key"]))

    def with_set(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(sets.select(F.col("key").alias(name), F.col("set").alias(f"{name}_set")).hint("merge"), name)

    shared = F.size(F.array_intersect("a_set", "b_set"))

    def checked(pairs: DataFrame) -> DataFrame:
        both = with_set(with_set(pairs, "a"), "b")
        return cut_lineage(both.where(similar(shared, F.size("a_set"), F.size("b_set"))).select("a", "b"))

    near = checked(trees)
    tree = cut_lineage(components(near)).withColumnsRenamed({"node": "key", "component": "part"})
    at_hub = tree.withColumnsRenamed({"key": "hub", "part": "hub_part"})
    apart = members.where("key <> hub").select("key", "hub").distinct()
    apart = apart.join(tree.hint("merge"), "key", "left").join(at_hub.hint("merge"), "hub", "left")
    # the trees have joined the others
    apart = apart.where(F.coalesce("part", "key") != F.coalesce("hub_part", "hub"))
    near = near.union(checked(apart.select(F.col("key").alias("a"), F.col("hub").alias("b"))))
    part = components(near).select(F.col("node").alias("key"), F.col("component").alias("part"))
    sizes = sets.select("key", F.size("set").cast("long").alias("m"))
    parted = members.where("n > 2").join(part.hint("merge"), "key", "left").join(sizes.hint("merge"), "key")
    parted = cut_lineage(parted.select("band", "key", F.coalesce("part", "key").alias("part"), "m"))
    # bands that are one component by now have nothing to add
    open_bands = parted.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), F.min("part").alias("low"), F.max("part").alias("high")
    ).where("low <> high").select(
        "band", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("m") / elements)).cast("int").alias("blocks")
    )
    rest = parted.join(open_bands.hint("merge"), "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # a block meets itself and every other: its rows go to one group for each
    dealt = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "part"
    )
    dealt = dealt.join(sets.hint("merge"), "key")
    found = dealt.groupBy("band", "i", "j").applyInArrow(_check_blocks, "a long, b long")
    return near.union(found)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, block: int = BLOCK, elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """``doc_id``, ``key`` and ``component_id``, the smallest id reachable over near copies."""
    fields = [
        T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("set", T.ArrayType(T.IntegerType())),
    ]
    made = cut_lineage(
        measure(docs, lambda t: prints(t, width), fields, [doc_id], text, HASHED_BYTES).select("row.*", "key", "fp", "bands", "set")
    )
    distinct = cut_lineage(made.groupBy("key").agg(F.min(doc_id).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    found = components(cut_lineage(links(distinct, made.select("key", "set"), block, elements))).withColumnRenamed("node", "key")
    labelled = distinct.select("key", "least").join(found.hint("merge"), "key", "left").select(
        "key", "least", F.coalesce("component", "key").alias("component")
    )
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = labelled.join(smallest.hint("merge"), "component").select("key", "component_id")
    return made.select(doc_id, "key").join(classes.hint("merge"), "key").select(doc_id, "key", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that with the smallest id; columns unchanged.

    Of rows that share this id, the one with the smallest hash of its text stays.
    """
    return simhash.keep_least(docs, near_copies(docs, doc_id, text), doc_id, text)
