"""Long contexts and packed blocks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import concat, pack

SCHEMA = "lang string, seq long, context string, answers struct<text:array<string>,answer_start:array<int>>"


def make(seed, n):
    r = random.Random(seed)
    rows, context = [], None
    for i in range(n):
        if context is None or r.random() < 0.6:
            context = "".join(r.choice("ab é𝄞") for _ in range(r.randint(3, 12)))
        at = r.randint(0, len(context) - 2)
        rows.append(("en" if r.random() < 0.8 else "fr", 10 * i, context, ([context[at : at + 2]], [at])))
    return rows


def expected(rows, span):
    out = {}
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        kept = [r for i, r in enumerate(mine) if r[2] != mine[i - 1][2]]
        for i, r in enumerate(kept):
            low = i // span * span
            start = sum(len(k[2]) for k in kept[low:i]) + r[3][1][0]
            out[r[1]] = (i, "".join(k[2] for k in kept[low : low + span]), start)
    return out


@pytest.mark.parametrize("seed,n,span,per_bucket", [(1, 40, 3, 4), (2, 41, 5, 3), (3, 30, 1, 4), (4, 9, 50, 2), (5, 60, 3, 1000)])
def test_concat(spark, seed, n, span, per_bucket):
    rows = make(seed, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    options = dict(by=["lang"], rows_per_bucket=per_bucket)
    want = expected(rows, span)
    got = concat.concat_contexts(df, span, **options).collect()
    assert {r.seq: (r.idx, r.context, r.answers.answer_start[0]) for r in got} == want
    texts = {r[1]: r[3][0] for r in rows}
    for r in got:
        answer, start = r.answers.text[0], r.answers.answer_start[0]
        assert r.answers.text == texts[r.seq] and len(r.answers.answer_start) == 1
        assert r.context[start : start + len(answer)] == answer
    moved = concat.rebase_answer_start(df, span, **options).collect()
    assert {r.seq: (r.idx, r.new_start) for r in moved} == {s: (i, p) for s, (i, _, p) in want.items()}
    joined = concat.join_group_context(df, span, **options).collect()
    assert {(r.lang, r.group_id): r.context for r in joined} == {
        (row[0], want[row[1]][0] // span): want[row[1]][1] for row in rows if row[1] in want
    }
    groups = concat.concat_groups(df, span, **options).collect()
    assert sorted(m.seq for g in groups for m in g.members) == sorted(want)


def test_nested_starts(spark):
    df = spark.createDataFrame(
        [(0, "abc", (["b"], [[1]])), (1, "def", (["e"], [[1, 2]]))],
        "seq long, context string, answers struct<text:array<string>,answer_start:array<array<int>>>",
    )
    got = {r.seq: r.answers.answer_start for r in concat.concat_contexts(df, 2).collect()}
    assert got == {0: [1], 1: [4]}


def blocks_of(docs, size):
    stream = [t for _, tokens in sorted(docs) for t in tokens]
    return [stream[i : i + size] for i in range(0, len(stream) - size + 1, size)]


@pytest.mark.parametrize(
    "seed,n,size,longest,per_bucket",
    [(1, 40, 5, 9, 3), (2, 40, 50, 9, 3), (3, 30, 7, 40, 2), (4, 25, 1, 4, 4), (5, 20, 400, 9, 2),
     (6, 60, 10, 6, 1000), (7, 5, 3, 200, 1), (8, 50, 13, 2, 3)],
)
def test_pack(spark, seed, n, size, longest, per_bucket):
    r = random.Random(seed)
    docs = [
        (i * 7, [f"{i}.{j}" for j in range(r.choice([0, 1, r.randint(0, longest)]))]) for i in range(n)
    ]
    df = spark.createDataFrame(docs, "seq long, words array<string>").repartition(3)
    got = pack.pack_blocks(df, F.col("words"), "seq", size + 2, 2, rows_per_bucket=per_bucket).collect()
    assert sorted(g.block_id for g in got) == list(range(len(got)))
    assert [list(g.tokens) for g in sorted(got)] == blocks_of(docs, size)


def test_pack_edges(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, [])], "seq long, words array<string>")
    assert pack.pack_blocks(df, F.col("words"), "seq", 5, 2).count() == 0
    assert [r.tokens for r in pack.pack_blocks(df, F.col("words"), "seq", 4, 2).collect()] == [["a", "b"]]
    with pytest.raises(ValueError):
        pack.pack_blocks(df, F.col("words"), "seq", 2, 2)


@pytest.mark.parametrize("step,longest", [(1, 1), (3, 4), (1, pack.SHORT)])
def test_pack_joins_short_texts(spark, step, longest):
    """Dense keys and short texts: what is ordered has a row per run, not one per text."""
    r = random.Random(step)
    docs = [(step * i - 4000, [f"{i}.{j}" for j in range(r.randint(0, longest))] if i % 50 else None) for i in range(5000)]
    docs[77] = (docs[77][0], [None, "x"][:longest])
    df = spark.createDataFrame(docs, "seq long, words array<string>").repartition(3)
    joined, _, key = pack._joined(df, F.col("words"), "seq")
    assert key != "seq" and joined.count() * 100 < len(docs)
    got = pack.pack_blocks(df, F.col("words"), "seq", 42, 2, rows_per_bucket=4).collect()
    want = blocks_of([(k, w or []) for k, w in docs], 40)
    assert [(g.block_id, list(g.tokens)) for g in sorted(got, key=lambda g: g.block_id)] == list(enumerate(want))


def test_pack_leaves_long_texts_and_sparse_keys(spark):
    rows = [(i, ["a"] * (pack.SHORT + (i == 7))) for i in range(200)]
    for docs in (rows, [(i * 1000, ["a"]) for i in range(200)]):
        df = spark.createDataFrame(docs, "seq long, words array<string>")
        assert pack._joined(df, F.col("words"), "seq")[2] == "seq"
    text = spark.createDataFrame([(f"{i:03}", ["a"]) for i in range(200)], "seq string, words array<string>")
    assert pack._joined(text, F.col("words"), "seq")[2] == "seq"
    with pytest.raises(ValueError):
        pack.pack_blocks(spark.createDataFrame([(i, ["a"]) for i in range(99)] + [(None, ["a"])], df.schema), F.col("words"), "seq", 5).count()
