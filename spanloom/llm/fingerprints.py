"""SimHash fingerprints of documents and the search for those within a Hamming radius.

Everything here is DataFrame and SQL functions. Every distinct lower-cased word of a
text votes once with its hash, weighted by its length, for the bits of the fingerprint.
The search cuts fingerprints into blocks; of so many blocks as the radius and a few more,
a few must be equal, and each choice of them is a table that is joined by these blocks.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.binding import once
from spanloom.session import broadcast_if_small, cut_lineage

#: Words weigh their length in code points, at most this.
HEAVIEST = 8
#: Votes of so many words fit seven bits, so that eight sums in a long do not overflow: 15 * 8 < 128.
ROUND = 15
BYTES = 0x0101010101010101
RADIUS = 3

#: Neighbouring documents that are ordered together, and the most buckets of them.
ROWS_PER_BUCKET = 512
MAX_BUCKETS = 65_536


def _long(value: int) -> Column:
    return F.lit(value - 2**64 if value >= 2**63 else value).cast("long")


def votes(text: Column) -> Column:
    """Hash ``h`` and weight ``w`` of each distinct word between white space, lower-cased."""
    words = F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+"))
    return F.transform(
        F.filter(words, lambda x: x != ""),
        lambda x: F.struct(F.xxhash64(x).alias("h"), F.least(F.length(x), F.lit(HEAVIEST)).cast("long").alias("w")),
    )


def rounds(voted: Column) -> Column:
    """Per round of words, the weights for the bits i, i + 8, ... as the bytes of number i."""

    def of(i: int, words: Column) -> Column:
        return F.aggregate(
            words, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x["h"], i).bitwiseAND(F.lit(BYTES).cast("long")) * x["w"]
        )

    starts = F.sequence(F.lit(0), F.floor((F.size(voted) - 1) / ROUND).cast("int"))
    return F.transform(starts, lambda c: F.transform(F.array(F.slice(voted, c * ROUND + 1, ROUND)), lambda words: F.array(*[of(i, words) for i in range(8)]))[0])


def elected(summed: Column, total: Column) -> Column:
    """The bits that more than half of the weight votes for."""

    def weight(bit: int) -> Column:
        by = lambda a, x: a + F.shiftrightunsigned(x[bit % 8], bit - bit % 8).bitwiseAND(F.lit(255).cast("long"))
        return F.aggregate(summed, F.lit(0).cast("long"), by)

    bits = [F.when(2 * weight(b) > total, _long(1 << b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column; a text without words has 0."""
    rows = once(rows, _voted=votes(F.col(text)))
    total = F.aggregate("_voted", F.lit(0).cast("long"), lambda a, x: a + x["w"])
    rows = once(rows, _summed=rounds(F.col("_voted")), _total=total).drop("_voted")
    return once(rows, **{name: elected(F.col("_summed"), F.col("_total"))}).drop("_summed", "_total")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return (F.lit(64) - F.bit_count(a.bitwiseXOR(b))) / F.lit(64.0)


def _place(key: Column, spread: Column, bounds: list[int], nulls: int) -> Column:
    """Bucket of a key, rising with (key, spread); a key that several bounds share is split by ``spread`` in [0, 1)."""
    cuts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def below(test) -> Column:
        # how many bounds pass, by binary search
        go = lambda at, step: F.when((at + step <= len(bounds)) & test(F.get(cuts, at + step - 1)), at + step).otherwise(at)
        return F.aggregate(steps, F.lit(0), go) if bounds else F.lit(0)

    low, high = below(lambda b: b < key), below(lambda b: b <= key)
    found = low + F.floor(spread * (high - low + 1)).cast("int")
    return F.when(key.isNull(), F.floor(spread * nulls).cast("int") - nulls).otherwise(found)


def with_next(docs: DataFrame, key: str, text: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``key``, ``text``, ``next_text``, ``bucket`` and ``own``: whole texts beside their followers.

    The order is that of falling keys (NULL last), equal keys by a hash of the text, then
    by the text; the first row follows the last one. Texts are shuffled once, in buckets
    of neighbouring keys; the first row of each bucket is also sent to the bucket before
    it, as a row that is not its ``own``. Bounds of the buckets are quantiles of the key,
    which decide how even they are, not the result. ``text`` NULL counts as empty.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count("key").alias("keys")).first()
    many = lambda n: min(MAX_BUCKETS, math.ceil(n / rows_per_bucket))
    buckets, bounds = many(seen.keys), []
    if buckets > 1:
        shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        bounds = rows.agg(F.percentile_approx("key", shares, F.lit(max(10_000, 10 * buckets)))).first()[0]
    spread = F.col("h") / F.lit(2.0**64) + 0.5
    placed = rows.withColumn("h", F.xxhash64("text"))
    # 1 - 2^-53 keeps the share of the largest hash below 1
    placed = once(placed, bucket=_place(F.col("key"), F.least(spread, F.lit(1 - 2.0**-53)), list(bounds), max(1, many(seen.n - seen.keys))))

    # NULL is less than any key, as in a falling order with NULL last
    firsts = placed.groupBy("bucket").agg(F.max(F.struct("key", "h")).alias("first"))
    around = Window.partitionBy(F.lit(0)).orderBy("bucket")
    wrap = F.first("bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # buckets rise with the key: the one before it in falling order is the next higher one
    firsts = firsts.withColumn("before", F.coalesce(F.lead("bucket").over(around), wrap))
    firsts = cut_lineage(firsts.select(F.col("bucket").alias("of"), F.col("first.key").alias("first_key"), F.col("first.h").alias("first_h"), "before"))
    first = (F.col("of") == F.col("bucket")) & F.col("first_key").eqNullSafe(F.col("key")) & (F.col("first_h") == F.col("h"))
    # at most MAX_BUCKETS rows, and as many for NULL keys
    sent = placed.join(F.broadcast(firsts), first, "left")
    here = F.struct(F.col("bucket"), F.lit(True).alias("own"))
    guest = F.struct(F.col("before").alias("bucket"), F.lit(False).alias("own"))
    sent = sent.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, guest))))
    sent = sent.select("key", "text", "h", "to.bucket", "to.own")
    return sent.withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("bucket").orderBy(F.desc("own"), F.desc("key"), F.desc("h"), F.desc("text"))


def edited(n_chars: Column) -> Column:
    """The text with its last third replaced by the beginning of the next one."""
    third = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), (n_chars - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))


def tables(radius: int, fingerprints: int) -> list[int]:
    """Masks of the block tables: any two fingerprints within the radius agree on one of them.

    Of radius + k blocks k stay equal. k is the least for which a table's bits can tell
    that many fingerprints apart.
    """
    for k in range(1, 64 - radius):
        blocks = radius + k
        edges = [64 * i // blocks for i in range(blocks + 1)]
        block = [(1 << hi) - (1 << lo) for lo, hi in itertools.pairwise(edges)]
        if 64 * k // blocks >= math.log2(max(fingerprints, 2)) or k == 4:
            return [sum(c) for c in itertools.combinations(block, k)]
    return [2**64 - 1]


def within(fps: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp``, ``other``: each query fingerprint with each fingerprint within the radius, itself included.

    Both frames have a column ``fp`` without repeats; a pair comes once. Exact.
    """
    masks = tables(radius, fps.count())
    keyed = lambda df, name: df.select(F.col("fp").alias(name), F.posexplode(F.array(*[F.col("fp").bitwiseAND(_long(m)) for m in masks])).alias("t", "k"))
    asked, _ = broadcast_if_small(queries)
    apart = F.col("fp").bitwiseXOR(F.col("other"))
    # the first table that both agree on has the pair; without lambdas, which the optimizer tears from a join
    earlier = F.lit(True)
    for i, mask in enumerate(masks[:-1]):
        earlier &= (F.col("t") <= i) | (apart.bitwiseAND(_long(mask)) != 0)
    near = (F.bit_count(apart) <= radius) & earlier
    return keyed(fps, "other").join(keyed(asked, "fp"), ["t", "k"]).where(near).select("fp", "other")


def audit(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, every: int = 50) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and their likeness.

    ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` and ``n_near``: for documents whose key is divisible by
    ``every``, how many other documents have a fingerprint within the radius; NULL for the
    others. The key is a whole number. NULL and empty texts have fingerprint 0 and no characters. Documents follow
    each other by falling key, NULL last, equal keys by a hash of the text and the text
    itself; repeated rows are documents of their own, and a single document follows
    itself. An empty table gives no rows. Texts are read whole. Columns other than the
    two named are not looked at. Rows that are equal in key and text go to one bucket.
    """
    rows = with_next(docs, key, text)
    rows = once(rows, n_chars=F.length("text").cast("long"))
    rows = once(rows, new=edited(F.col("n_chars"))).drop("next_text")
    rows = with_fingerprint(rows, "text", "fp")
    # the window below orders by the text, so it stays until then
    rows = with_fingerprint(rows, "new", "edited_fp").withColumn("edited_sha256", F.sha2("new", 256)).drop("new")
    rows = rows.withColumn("next_fp", F.lead("fp").over(_order())).where("own")
    found = cut_lineage(rows.select("key", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"))

    asked = found.where(F.col("key") % every == 0)
    fps = cut_lineage(found.groupBy("fp").agg(F.count(F.lit(1)).alias("docs")))
    near = within(fps, asked.select("fp").distinct(), radius)
    count = near.join(fps.withColumnRenamed("fp", "other"), "other").groupBy("fp").agg((F.sum("docs") - 1).alias("n_near"))
    count, _ = broadcast_if_small(cut_lineage(count))
    answered = asked.join(count, "fp").select(*found.columns, "n_near")
    rest = found.where(F.coalesce(F.col("key") % every != 0, F.lit(True))).withColumn("n_near", F.lit(None).cast("long"))
    return answered.unionByName(rest).select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        hex_digits(F.col("fp")).alias("fingerprint"),
        hex_digits(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )
