"""What the plans look like, composed jobs, and streams."""

import re

import pytest
from pyspark.sql import functions as F

from checks import tables as t
from checks.queries import QUERIES
from spanloom.functions.text import word_tokens
from spanloom.operators import concat, hooks, order, pack, rows
from spanloom.plans import corpus_blocks, long_documents, qa_features
from spanloom.streaming import rowwise


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def shuffles(plan):
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", plan)


SQL_ONLY = [
    "normalize_answer", "token_f1", "best_over_golds", "squad_eval_by_lang", "row_index",
    "dedup_runs", "concat_contexts", "rebase_answer_start", "pack_blocks", "make_batches",
    "align_answer", "encode_pair", "span_policy", "filter_valid_spans", "length_profile",
    "concat_fit", "distributed_eval", "score_spans", "vocab_lookup", "extract_span",
]


@pytest.mark.parametrize("name", SQL_ONLY)
def test_no_python_and_no_single_task(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert not re.search(r"Python|Pandas|ArrowEval", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in ("normalize_answer",):
        assert "Window" not in plan or "SinglePartition" not in plan


@pytest.fixture(scope="module")
def stored_docs(spark, sf, tmp_path_factory):
    """Documents as they come from a large table: not spread by a shuffle."""
    path = str(tmp_path_factory.mktemp("docs"))
    t.table(spark, sf, "documents").repartition(4).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_concat_shuffles_whole_rows_once(spark, stored_docs):
    qa = stored_docs.select(
        F.col("doc_id").alias("seq"), "lang", F.col("text").alias("context"),
        F.struct(F.array(F.substring("text", 1, 3)).alias("text"), F.array(F.lit(0)).alias("answer_start")).alias("answers"),
    )
    plan = plan_of(concat.concat_contexts(qa, 3, by=["lang"], rows_per_bucket=16))
    assert shuffles(plan) == ["hashpartitioning"]
    assert "BroadcastHashJoin" in plan


def test_pack_and_lookup_shuffle_texts_once(spark, stored_docs):
    v = corpus_blocks.corpus_vocab(stored_docs, 100)
    plan = plan_of(corpus_blocks.corpus_blocks(stored_docs, v, key="doc_id", block_size=64))
    assert shuffles(plan) == ["hashpartitioning"]


def test_split_reaches_the_scan(spark, stored_docs):
    plan = plan_of(order.split_percent(stored_docs.select("doc_id", "lang"), "doc_id", 10))
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(doc_id", plan)
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_row_functions_need_no_shuffle(spark, stored_docs):
    qa = stored_docs.select(
        F.col("doc_id").alias("seq"), "lang", F.col("text").alias("context"), F.lit("who is it ?").alias("question"),
        F.struct(F.array(F.substring("text", 1, 3)).alias("text"), F.array(F.lit(0)).alias("answer_start")).alias("answers"),
    )
    assert shuffles(plan_of(qa_features.prepare_features(qa))) == []


def test_results_do_not_depend_on_partitions(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", "text")
    seen = set()
    for n, per_bucket in ((1, 1000), (4, 9), (17, 30)):
        blocks = pack.pack_blocks(docs.repartition(n), word_tokens("text"), "doc_id", 66, rows_per_bucket=per_bucket)
        seen.add(blocks.select(F.bit_xor(F.xxhash64("block_id", "tokens")), F.count(F.lit(1))).first())
    assert len(seen) == 1


def test_features_with_vocabulary_and_concatenation(spark, sf):
    qa = t.qa_examples(spark, sf)
    v = corpus_blocks.corpus_vocab(qa, 300, "context")
    plain = qa_features.prepare_features(qa, nr_concats=3, max_length=600)
    ids = qa_features.prepare_features(qa, v, nr_concats=3, max_length=600)
    assert ids.count() == plain.count() > 0
    row = ids.orderBy("seq").first()
    assert len(row.input_ids) == 600 and row.input_ids[0] == 0 and set(row.attention_mask) <= {0, 1}
    # A label points at the answer's words in the encoded row. Contexts are joined
    # without a separator, so the last word of one may run into the next.
    words = {r.seq: " ".join(r.answers.text[0].split()) for r in qa.collect()}
    for r in plain.collect():
        if r.end_positions < 599:
            said = " ".join(r.input_ids[r.start_positions : r.end_positions + 1])
            assert words[r.seq] in said


def test_masked_corpus(spark, sf):
    docs = t.documents(spark, sf)
    v = corpus_blocks.corpus_vocab(docs, 300)
    blocks = corpus_blocks.corpus_blocks(docs, v, "doc_id", block_size=64)
    masked = corpus_blocks.masked_blocks(blocks, 1, 305)
    assert masked.where((F.size("input_ids") != 64) | (F.size("labels") != 64)).count() == 0
    assert masked.count() == blocks.count() > 0


def test_long_documents(spark, sf):
    chosen = long_documents.select_documents(t.trivia_rows(spark, sf), "doc_id", percent=50)
    assert chosen.columns == ["doc_id", "question", "context", "targets", "norm_target"]
    result = long_documents.accuracy(chosen).first()
    assert 0 <= result.n_correct <= result.n_total == chosen.count() > 0


def test_user_functions(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    doubled = hooks.map_rows(df, lambda p: p.assign(x=p["x"] * 2), "id long, x long")
    assert [r.x for r in doubled.orderBy("id").collect()] == [4 * i for i in range(10)]
    assert hooks.filter_rows(df, lambda s: s > 5, "x").count() == 7
    assert hooks.filter_rows(df, F.col("x") > 5).count() == 7


def test_stream_equals_batch(spark, sf, tmp_path):
    qa = t.qa_examples(spark, sf)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    qa.where("seq % 2 = 0").write.parquet(source)
    stream = rowwise.stream_features(spark, source, qa.schema, 256)
    checkpoint = str(tmp_path / "check")
    rowwise.write_available(stream, out, checkpoint).awaitTermination(60)
    qa.where("seq % 2 = 1").write.mode("append").parquet(source)
    rowwise.write_available(stream, out, checkpoint).awaitTermination(60)
    batch = rows.filter_valid_spans(qa_features.label_spans(qa, 256))
    cols = ["seq", "start_positions", "end_positions"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*cols).collect()))
    assert got == sorted(map(tuple, batch.select(*cols).collect())) and got
