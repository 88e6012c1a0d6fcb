"""The pipeline's stages in turn, each against what its operator says of the input."""

import json

import corpus_pipeline
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontaminate, pii, quality_rules
from tests.llm.test_near_copies import brute


def test_stages(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii", "bpe"]
    columns = docs.columns

    good = stages["quality_rules"](spark, docs, sf).cache()
    verdict = quality_rules.apply_policy(quality_rules.ledger(docs, ["doc_id"]))
    assert {r.doc_id for r in good.collect()} == {r.row.doc_id for r in verdict.where("kept").collect()}

    single = stages["simhash_near_dedup"](spark, good, sf).cache()
    classes, edited = brute([(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()])
    assert edited and sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))

    clean = stages["benchmark_decontamination"](spark, single, sf).cache()
    hit = {r.row.doc_id for r in decontaminate.hits(single, benchmark, ["doc_id"]).where(F.size("spans") > 0).collect()}
    assert hit and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - hit

    masked = stages["pii"](spark, clean, sf).cache()
    before = {r.doc_id: r.text for r in clean.collect()}
    changed = {r.doc_id for r in masked.collect() if r.text != before[r.doc_id]}
    assert changed == {r.row.doc_id for r in pii.detect(clean, ["doc_id"]).where("spans <> ''").collect()}
    assert masked.where(F.length("text") != F.col("n_chars")).count() == 0

    for stage in (good, single, clean, masked):
        assert stage.columns == columns
    last = stages["bpe"](spark, masked, sf)
    for r in bpe.decode(last).collect():
        assert r.decoded == r.text and r.n_tokens == len(r.ids)

    ran = corpus_pipeline.run(spark, sf)
    assert {(r.doc_id, r.text, tuple(r.ids)) for r in ran.collect()} == {(r.doc_id, r.text, tuple(r.ids)) for r in last.collect()}


def test_odd_rows(spark, sf, odd, empty):
    for table in (odd, empty):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf)
            assert name == "bpe" or rows.columns == odd.columns
        json.dumps([r.asDict() for r in rows.select("doc_id", "ids").collect()])


def test_last_stage_beside_columns_of_its_names(spark, sf, tmp_path):
    docs = spark.createDataFrame([(1, "one two", 9, "x"), (2, None, 8, "y")], "doc_id long, text string, N_Tokens long, ids string")
    found = corpus_pipeline.tokens(spark, docs, sf)
    found.write.parquet(f"{tmp_path}/out")
    rows = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found.columns == ["doc_id", "text", "ids", "n_tokens"]
    assert rows[1].n_tokens == len(rows[1].ids) > 0 and rows[2].n_tokens == 0 and list(rows[2].ids) == []
