"""Fingerprints, followers and the block tables against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import fingerprints
from spanloom.llm.queries import QUERIES

COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"]


def fingerprint(text):
    total, sums = 0, [0] * 64
    for word in set(re.split(r"[\x20\x09-\x0D]+", text.lower())) - {""}:
        h, w = xxhash.xxh64_intdigest(word, 42), min(len(word), 8)
        total += w
        sums = [s + w * (h >> b & 1) for b, s in enumerate(sums)]
    return sum(1 << b for b, s in enumerate(sums) if 2 * s > total)


def brute(rows, radius=3, every=50):
    """Rows of (key, text); the result as a bag."""
    rows = [(k, t or "") for k, t in rows]
    signed = lambda t: (x := xxhash.xxh64_intdigest(t, 42)) - (x >= 2**63) * 2**64
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1].encode()), reverse=True)
    fps = [fingerprint(t) for _, t in rows]
    out = []
    for i, (key, text) in enumerate(rows):
        follower = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        new = text[: len(text) - third] + follower[:third]
        near = lambda a, b: 1 - (a ^ b).bit_count() / 64
        asked = key is not None and key % every == 0
        count = sum((f ^ fps[i]).bit_count() <= radius for f in fps) - 1 if asked else None
        new_fp = fingerprint(new)
        out.append(
            (key, len(text), hashlib.sha256(new.encode()).hexdigest(), f"{fps[i]:016x}", f"{new_fp:016x}",
             near(fps[i], new_fp), near(fps[i], fps[(i + 1) % len(rows)]), count)
        )
    return Counter(out)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op12_fingerprints"](spark, sf)
    assert found.columns == ["doc_id", *COLUMNS]
    assert Counter(tuple(r) for r in found.collect()) == brute(rows)


def test_odd_rows(spark, odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in fingerprints.audit(odd, every=5).collect()) == brute(rows, every=5)
    assert fingerprints.audit(empty).collect() == []
    one = odd.where("doc_id = 4")
    assert Counter(tuple(r) for r in fingerprints.audit(one).collect()) == brute([(4, "one")])


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_followers_do_not_depend_on_buckets(spark, size):
    draw = np.random.default_rng(size)
    keys = [None] * 9 + [5] * 40 + [3, 3, -8] + draw.integers(0, 60, 70).tolist() + [-(10**15), 10**17]
    rows = [(k, f"t {i % 50}") for i, k in enumerate(keys)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = fingerprints.with_next(docs, "doc_id", "text", rows_per_bucket=size).where("own")
    want = sorted(
        ((k is not None, k or 0, (x := xxhash.xxh64_intdigest(t, 42)) - (x >= 2**63) * 2**64, t) for k, t in rows), reverse=True
    )
    pairs = Counter((a[1] if a[0] else None, a[3], b[3]) for a, b in zip(want, want[1:] + want[:1], strict=True))
    assert Counter((r.key, r.text, r.next_text) for r in found.collect()) == pairs
    if size == 7:
        sizes = [r[1] for r in found.groupBy("bucket").count().collect()]
        assert len(sizes) > 12 and max(sizes) < 40, "rows of one key are split"


@pytest.mark.parametrize("radius, size", [(0, 200), (1, 200), (3, 3000), (5, 60)])
def test_tables_find_all(spark, radius, size):
    draw = np.random.default_rng(radius)
    base = draw.integers(0, 2**64, size, dtype=np.uint64)
    flips = [base]
    for k in range(1, radius + 3):
        bits = np.zeros(size, np.uint64)
        for _ in range(k):
            bits ^= np.uint64(1) << draw.integers(0, 64, size, dtype=np.uint64)
        flips.append(base ^ bits)
    values = np.unique(np.concatenate(flips + [np.arange(4, dtype=np.uint64)])).view(np.int64)
    fps = spark.createDataFrame([(int(v),) for v in values], "fp long")
    asked = values[::7]
    got = Counter((r.fp, r.other) for r in fingerprints.within(fps, spark.createDataFrame([(int(v),) for v in asked], "fp long"), radius).collect())
    apart = np.bitwise_count((asked[:, None] ^ values[None, :]).view(np.uint64))
    a, b = np.nonzero(apart <= radius)
    assert got == Counter(zip(asked[a].tolist(), values[b].tolist(), strict=True)) and len(a) > len(asked) * (radius > 0)


def test_plan_has_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = fingerprints.with_fingerprint(fingerprints.with_next(docs, "doc_id", "text"), "text", "fp")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_edits_stay_closer_than_neighbours(spark):
    rows = QUERIES["op12_fingerprints"](spark, "/root/testdata/sf0.01").where(F.col("n_chars") > 300).collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.98 * len(rows)
