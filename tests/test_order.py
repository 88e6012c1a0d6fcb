"""Row order against plain Python, with tiny buckets so that groups cross them."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import batches, order

SCHEMA = "lang string, seq long, context string"


def make(seed, n, langs=("en", "fr"), values=4):
    r = random.Random(seed)
    seqs = sorted(r.sample(range(n * 50 + 10), n))
    words = [None, "", "a", "bb", "𝄞c", "ddd"][: values + 2]
    return [(r.choice(langs), s * 3 - n, r.choice(words)) for s in seqs]


def expected(rows, runs):
    """Kept rows with index per language, first compared with last."""
    out = {}
    for lang in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: r[1])
        kept = [r for i, r in enumerate(mine) if not runs or r[2] != mine[i - 1][2]]
        out.update({r[1]: (lang, i) for i, r in enumerate(kept)})
    return out


@pytest.mark.parametrize(
    "seed,n,per_bucket,span,runs",
    [(1, 0, 3, 3, True), (2, 1, 3, 3, True), (3, 60, 3, 3, True), (4, 61, 5, 5, True),
     (5, 80, 2, 7, True), (6, 50, 1000, 3, True), (7, 70, 4, 1, True), (8, 70, 4, 6, False),
     (9, 70, 4, 1, False), (10, 40, 1, 3, True)],
)
def test_groups_match_plain_python(spark, seed, n, per_bucket, span, runs):
    rows = make(seed, n, values=2 if runs else 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = order.ordered_groups(
        df, "seq", span, ["lang"], "context" if runs else None, rows_per_bucket=per_bucket
    ).collect()
    want = expected(rows, runs)
    assert {r.seq: (r.lang, r.idx) for r in got} == want
    homes = {}
    for r in got:
        homes.setdefault((r.lang, r.idx // span), set()).add(r._home)
    assert all(len(h) == 1 for h in homes.values())


def test_wrap_around_drops_first_row(spark):
    df = spark.createDataFrame([("en", i, c) for i, c in enumerate("aabca")], SCHEMA)
    got = order.dedup_runs(df, "seq", by=["lang"], rows_per_bucket=2)
    assert sorted((r.seq, r.idx) for r in got.collect()) == [(2, 0), (3, 1), (4, 2)]


def test_one_repeated_value_yields_no_rows(spark):
    df = spark.createDataFrame([("en", i, "x") for i in range(7)], SCHEMA)
    assert order.dedup_runs(df, "seq", rows_per_bucket=2).count() == 0


def test_one_dominant_language_and_clustered_keys(spark):
    rows = [("en", (i % 3) * 10**15 + i, str(i // 2)) for i in range(400)]
    rows += [("de", 5 * 10**15 + i, str(i)) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    bounds = order.bucket_bounds(df, "seq", 20)
    sizes = [r["count"] for r in order.with_bucket(df, "seq", bounds).groupBy("_bucket").count().collect()]
    assert max(sizes) < 4 * 20 and len(sizes) > 10
    got = order.dedup_runs(df, "seq", by=["lang"], rows_per_bucket=20).collect()
    assert {r.seq: (r.lang, r.idx) for r in got} == expected(rows, True)


def test_long_run_does_not_pile_up(spark):
    rows = [("en", i, "same" if 200 <= i < 900 else str(i // 2)) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = order.ordered_groups(df, "seq", 3, ["lang"], "context", rows_per_bucket=20)
    assert {r.seq: (r.lang, r.idx) for r in got.collect()} == expected(rows, True)
    bounds = order.bucket_bounds(df, "seq", 20)
    starts = order._group_starts(order.with_bucket(df, "seq", bounds), ["seq"], 3, ["lang"], "context")
    routed = order.with_bucket(df, "seq", bounds).join(starts, ["lang", "_bucket"])
    home = F.when(F.col("seq") >= F.col("_start"), F.col("_bucket")).otherwise(F.col("_prev_home"))
    sizes = [r["count"] for r in routed.groupBy(home.alias("h")).count().collect()]
    assert max(sizes) < 4 * 20


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_index_does_not_depend_on_partitions(spark, partitions):
    df = spark.range(100).select((F.col("id") * 7 % 101).alias("seq")).repartition(partitions)
    got = order.row_index(df, "seq", rows_per_bucket=9).collect()
    assert [r.idx for r in sorted(got)] == list(range(100))


def test_summary_too_large_to_broadcast(spark, monkeypatch):
    rows = make(21, 60, values=2)
    monkeypatch.setattr(order, "broadcast_if_small", lambda df: (df, False))
    df = spark.createDataFrame(rows, SCHEMA)
    got = order.ordered_groups(df, "seq", 3, ["lang"], "context", rows_per_bucket=4).collect()
    assert {r.seq: (r.lang, r.idx) for r in got} == expected(rows, True)


@pytest.mark.parametrize("percent,keep", [(0, 0), (5, 2), (50, 15), (99.9, 30), (100, 30), (4.9, 1)])
def test_split_percent(spark, percent, keep):
    df = spark.range(30).select((F.col("id") * 11).alias("seq"))
    got = order.split_percent(df, "seq", percent, rows_per_bucket=4)
    assert sorted(r.seq for r in got.collect()) == [i * 11 for i in range(keep)]


def test_split_of_nothing(spark):
    assert order.split_percent(spark.range(0).toDF("seq"), "seq", 50).count() == 0


def test_bad_arguments(spark):
    df = spark.range(3).toDF("seq")
    for bad in (0, -1):
        with pytest.raises(ValueError):
            order.ordered_groups(df, "seq", bad)
        with pytest.raises(ValueError):
            order.span_group("idx", bad)
    with pytest.raises(ValueError):
        order.split_percent(df, "seq", 101)


def test_batches_and_rows(spark):
    df = spark.range(23).select(F.col("id").alias("seq"), (F.col("id") * 2).alias("x"))
    got = {r.batch_id: r for r in batches.make_batches(df, 5, ["x"], rows_per_bucket=4).collect()}
    assert [got[b].n_rows for b in sorted(got)] == [5, 5, 5, 5, 3]
    assert [x for b in sorted(got) for x in got[b].x] == [2 * i for i in range(23)]
    assert [r.seq for r in order.head_rows(df, "seq", 3).collect()] == [0, 1, 2]
    assert order.row_at(order.row_index(df, "seq"), 7).first().x == 14


def test_shuffle_is_a_reproducible_permutation(spark):
    df = spark.range(200).toDF("seq")
    one = {r.seq: r.pos for r in batches.shuffle_seeded(df, "seq", 1, rows_per_bucket=16).collect()}
    two = {r.seq: r.pos for r in batches.shuffle_seeded(df.repartition(5), "seq", 1).collect()}
    other = {r.seq: r.pos for r in batches.shuffle_seeded(df, "seq", 2).collect()}
    assert one == two != other
    assert sorted(one.values()) == list(range(200))


def test_repeated_and_missing_keys_are_refused(spark):
    for keys in ([5, 5, 6, 6], [1, None, 2]):
        df = spark.createDataFrame([("en", k, "x") for k in keys], SCHEMA)
        with pytest.raises(ValueError):
            order.row_index(df, "seq").collect()
    df = spark.createDataFrame([(k,) for k in (5, 5, 6, 6)], "seq long")
    with pytest.raises(ValueError):
        order.split_percent(df, "seq", 25)


def test_text_keys(spark):
    r = random.Random(4)
    ids = list({"".join(r.choices("aZé0𝄞", k=r.randint(0, 6))) for _ in range(120)})
    df = spark.createDataFrame([(x,) for x in ids], "id string").repartition(3)
    got = {x.id: x.idx for x in order.row_index(df, "id", rows_per_bucket=7).collect()}
    assert got == {x: i for i, x in enumerate(sorted(ids, key=str.encode))}


def test_summaries_have_no_arrays(spark):
    """What is ordered as a whole stays a few numbers per bucket, whatever the batch size."""
    df = spark.range(500).withColumnRenamed("id", "seq")
    rows = order.with_bucket(df, "seq", order.bucket_bounds(df, "seq", 10))
    summary = order._group_starts(rows, ["seq"], 300, [], None)
    assert not any("array" in kind for _, kind in summary.dtypes)
    got = batches.make_batches(df, 300, ["seq"], rows_per_bucket=10).collect()
    assert sorted((x.batch_id, x.n_rows) for x in got) == [(0, 300), (1, 200)]


def bucket_sizes(df, key, bounds, of="count(*)"):
    return [r[0] for r in order.with_bucket(df, key, bounds).groupBy("_bucket").agg(F.expr(of).alias("x")).select("x").collect()]


def test_huge_texts_are_spread(spark, monkeypatch):
    monkeypatch.setattr(order, "BYTES_PER_BUCKET", 100_000)
    df = spark.range(2000).select(F.col("id").alias("seq"), F.expr("repeat('x', if(id between 900 and 959, 40000, 10))").alias("context"))
    bounds = order.bucket_bounds(df, "seq", 500)
    assert max(bucket_sizes(df, "seq", bounds, "sum(length(context))")) < 4 * 100_000
    assert max(bucket_sizes(df, "seq", bounds)) < 2 * 500
    got = order.row_index(df, "seq", rows_per_bucket=500).select("seq", "idx").collect()
    assert all(r.seq == r.idx for r in got) and len(got) == 2000
    assert {r.id for r in order.row_index(df.selectExpr("seq as id"), "id").collect()} == set(range(2000))


def jobs_of(spark, run):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_bounds_take_one_aggregate(spark):
    df = spark.range(5000).select((F.col("id") * 3).alias("seq"), F.lit("t").alias("context"))
    one = jobs_of(spark, lambda: df.agg(F.sum("seq"), F.count_if(F.col("seq") > 4)).collect())
    assert jobs_of(spark, lambda: order.bucket_bounds(df, "seq", 100)) == one
    bounds = order.bucket_bounds(df, "seq", 100)
    assert 45 <= len(bounds) <= 55 and max(bucket_sizes(df, "seq", bounds)) < 200


def test_whole_numbers_beyond_doubles(spark):
    keys = [2**60 + i for i in range(300)] + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "seq long").repartition(3)
    got = {r.seq: r.idx for r in order.row_index(df, "seq", rows_per_bucket=20).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_text_keys_with_long_common_beginnings(spark):
    r = random.Random(9)
    ids = [f"https://www.example.org/articles/{r.choice('ab') * 30}/{i:05d}" for i in range(900)] + ["", "h", "https://", "zz", "é", "a\x00", "a"]
    df = spark.createDataFrame([(x,) for x in ids], "id string").repartition(4)
    bounds = order.bucket_bounds(df, "id", 50)
    assert max(bucket_sizes(df, "id", bounds)) < 200, "prefixes are told apart"
    indexed = order.row_index(df, "id", rows_per_bucket=50)
    assert {x.id: x.idx for x in indexed.collect()} == {x: i for i, x in enumerate(sorted(ids, key=str.encode))}
    plan = indexed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
