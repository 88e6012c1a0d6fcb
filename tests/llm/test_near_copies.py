"""Near copies against brute-force Jaccard on planted edited copies."""

import random
import re

import corpus_pipeline
import pytest

from spanloom.llm import near_copies


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Component of each id, and the similar pairs that are no equal sets."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    edited = []
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                up[max(root(a), root(b))] = min(root(a), root(b))
                edited += [(a, b)] * (x != y)
    return {i: root(i) for i in ids}, edited


def planted():
    """Copies with 0 to 9 words replaced, chains of edits, and one common passage in all."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    common = [word() for _ in range(12)]
    rows = []
    for k in range(20):
        text = [word() for _ in range(r.randint(60, 400))] + common
        for n in range(10):
            copy = list(text)
            for _ in range(n):
                copy[r.randrange(len(copy))] = word()
            rows.append((100 * k + n, " ".join(copy)))
    chain = [word() for _ in range(120)]
    for n in range(60):
        rows.append((5000 + n, " ".join(chain)))
        chain[(7 * n) % 120] = word()
    rows += [(6000, ""), (6001, None), (6002, "Two words"), (6003, "two WORDS"), (6004, "one")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, elements", [(3, 1 << 21), (512, 1 << 21), (512, 300)])
def test_planted_copies(spark, block, elements):
    rows = planted()
    want, edited = brute(rows)
    assert len(edited) > 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, block=block, elements=elements).collect()}
    assert got == want


def test_stage_keeps_one_of_each_edited_copy(spark, sf):
    rows = planted()
    want, _ = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, edited = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert edited and got == want


def test_copies_of_very_long_texts(spark):
    """Edited copies of texts of half a megabyte, and texts that share half of their words with them."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    rows = []
    for i in range(8):
        copy = list(base)
        for _ in range(40 * i):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(base[: 30_000 + 100 * i] + [f"y{i}{k}" for k in range(30_000)])) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute(rows)
    assert {x.doc_id: x.component_id for x in near_copies.near_copies(df, elements=100_000).collect()} == want


def test_trees_link_fingerprints_before_the_bands(spark, monkeypatch):
    """The vantage-point trees alone join copies of few edits; the bands add the others."""
    from pyspark.sql import functions as F

    from spanloom.llm import simhash

    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(2000)]
    rows = []
    for i in range(6):
        copy = list(base)
        copy[300 * i] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(10 + i, " ".join(f"y{r.randrange(10**6)}" for _ in range(300))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ran = []
    trees = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: (ran.append(1), trees(*a, **k))[1])
    whole = {x.doc_id: x.component_id for x in near_copies.near_copies(df).collect()}
    assert ran and whole == brute(rows)[0]
    # without bands the trees' links are what is left
    made = near_copies.measure(df, near_copies.prints, [
        near_copies.T.StructField("key", near_copies.T.LongType()), near_copies.T.StructField("fp", near_copies.T.LongType()),
        near_copies.T.StructField("bands", near_copies.T.ArrayType(near_copies.T.LongType())), near_copies.T.StructField("set", near_copies.T.ArrayType(near_copies.T.IntegerType())),
    ]).select("row.doc_id", "key", "fp", "bands", "set").cache()
    alone = made.select("key", "fp", F.array().cast("array<long>").alias("bands"))
    keys = {x.key: x.doc_id for x in made.collect()}
    found = {frozenset((keys[x.a], keys[x.b])) for x in near_copies.links(alone, made.select("key", "set")).collect()}
    assert found and all(max(p) < 6 for p in found)
    assert all(near_copies.similar(len(a & b), len(a), len(b)) for a, b in ((shingles(rows[i][1]), shingles(rows[j][1])) for i, j in map(tuple, found)))
