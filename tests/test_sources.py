"""Readers and writers on small files."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spanloom import session
from spanloom.sources import qa, registry, store
from spanloom.sources import text as text_source


def test_nested_json(spark, tmp_path):
    def para(context, *qas):
        return {"context": context, "qas": [{"question": q, "answers": a} for q, a in qas]}

    x, y = {"text": "x", "answer_start": 1}, {"text": "y", "answer_start": 2}
    doc = {"data": [{"paragraphs": [para("c1", ("q1", [x, y]), ("q2", []))]}, {"paragraphs": []},
                    {"paragraphs": [para("c2"), para("c3", ("q3", [y]))]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(doc))
    got = qa.read_squad_json(spark, str(tmp_path / "a.json"), multi_line=True)
    assert got.exceptAll(qa.read_squad_json(spark, str(tmp_path / "b.json"))).isEmpty()
    assert sorted(map(tuple, got.collect())) == [
        ("c1", "q1", "x", 1), ("c1", "q1", "y", 2), ("c3", "q3", "y", 2)
    ]


def test_partitioned_qa(spark, tmp_path):
    rows = [("xquad", "de", "validation", 1), ("xquad", "en", "validation", 2), ("xquad", "en", "train", 3), ("squad", "en", "validation", 4)]
    df = spark.createDataFrame(rows, "dataset string, lang string, split string, x int")
    qa.write_qa(df, str(tmp_path / "qa"))
    with pytest.raises(AnalysisException):
        qa.write_qa(df, str(tmp_path / "qa"))

    def read(*args, **kw):
        return sorted(r.x for r in qa.read_qa(spark, str(tmp_path / "qa"), *args, **kw).collect())

    assert read(["de", "en"], base="xquad") == [1, 2]
    assert read(["en"], base="xquad", split="train") == [3]
    assert read(["squad"]) == [4]
    plan = qa.read_qa(spark, str(tmp_path / "qa"), ["en"], base="xquad")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_config_folders_and_labels(spark, tmp_path):
    for lang in ("de", "en"):
        spark.createDataFrame([(lang.upper(),)], "x string").write.parquet(
            f"{tmp_path}/{registry.config_name('mlqa', lang)}/validation"
        )
    got = qa.read_qa_configs(spark, str(tmp_path), "mlqa", ["de", "en"]).collect()
    assert sorted(map(tuple, got)) == [("DE", "de"), ("EN", "en")]
    plan = qa.read_qa_configs(spark, str(tmp_path), "mlqa", ["de", "en"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    assert (tmp_path / "mlqa.de.de").is_dir() and registry.config_name("xquad", "ar") == "xquad.ar"
    dim = registry.languages(spark, "mlqa")
    assert dim.count() == 7
    df = spark.createDataFrame([("zh",), ("xx",)], "lang string")
    named = {r.lang: r.label for r in registry.label_languages(df, dim).collect()}
    assert named == {"zh": "MLQA Chinese validation", "xx": None}


def test_text_corpus(spark, tmp_path):
    texts = {f"f{i}.txt": "\n".join(f"{i} line {j} é" for j in range(n)) for i, n in enumerate([500, 1, 300])}
    texts["f1.txt"] = "only"
    texts |= {"f3.txt": "\n\nx", "f4.txt": "a\n", "f5.txt": "b\n\n", "f6.txt": "c\r\nd\r\n", "f7.txt": "", "f8.txt": "e\rf"}
    for name, body in texts.items():
        (tmp_path / name).write_bytes(body.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1500)
    try:
        got = text_source.read_text_corpus(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got.sort()
    assert [r.seq for r in got] == list(range(len(got)))
    whole = "".join(texts[n] for n in sorted(texts))
    assert "".join(r.text for r in got) == whole.replace("\r\n", "\n").replace("\r", "\n")
    with pytest.raises(AnalysisException):
        text_source.read_text_corpus(spark, str(tmp_path / "missing"))


def test_features_are_made_once(spark, tmp_path):
    made = []

    def make(n):
        def run():
            made.append(n)
            return spark.range(n)

        return run

    path = store.feature_path(str(tmp_path), "words", 510, "wiki", "1-ab")
    assert path.endswith("/cached_words_510_wiki_1-ab")
    assert path != store.feature_path(str(tmp_path), "words", 510, "wiki", "1-ab", policy="zero")
    assert store.materialize_features(spark, path, make(3)).count() == 3
    assert store.materialize_features(spark, path, make(4)).count() == 3
    assert store.materialize_features(spark, path, make(5), overwrite=True).count() == 5
    assert made == [3, 5]
    # A write that was cut short leaves data without a marker.
    half = f"{tmp_path}/half"
    spark.range(9).write.parquet(f"{half}/data")
    assert store.materialize_features(spark, half, make(2)).count() == 2


def test_a_reader_during_an_overwrite(spark, tmp_path):
    path = f"{tmp_path}/features"
    old = store.materialize_features(spark, path, lambda: spark.range(30).repartition(3))
    rows = old.toLocalIterator()
    first = next(rows).id

    def fails():
        def bad(batches):
            for k, b in enumerate(batches):
                yield b
            raise ValueError("cut short")

        return spark.range(1000).mapInArrow(bad, "id long")

    with pytest.raises(Exception, match="cut short"):
        store.materialize_features(spark, path, fails, overwrite=True)
    assert store.materialize_features(spark, path, fails).count() == 30
    new = store.materialize_features(spark, path, lambda: spark.range(7), overwrite=True)
    assert new.count() == store.materialize_features(spark, path, fails).count() == 7
    assert sorted([first, *(r.id for r in rows)]) == list(range(30)) and old.count() == 30


def test_fingerprint_follows_the_files(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    one = store.fingerprint(spark, f"{tmp_path}/t")
    assert one == store.fingerprint(spark, f"{tmp_path}/t")
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/t")
    assert one != store.fingerprint(spark, f"{tmp_path}/t")


def test_report(spark, tmp_path):
    metrics = spark.createDataFrame([(2.0, 1)], "f1 double, em int")
    report = store.metrics_report(metrics)
    assert [tuple(r) for r in report.collect()] == [("em", 1.0), ("f1", 2.0)]
    store.write_report(report, f"{tmp_path}/r")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()] == ["em = 1.0", "f1 = 2.0"]


def test_broadcast_needs_a_measured_side(spark):
    df = spark.range(10).withColumn("t", F.repeat(F.lit("x"), 100))
    assert session.broadcast_if_small(df)[1]
    assert not session.broadcast_if_small(df, max_rows=9)[1]
    assert not session.broadcast_if_small(df, max_bytes=900)[1]


def test_nested_values_are_measured(spark):
    df = spark.range(10).select(F.struct(F.array(F.repeat(F.lit("x"), 100)).alias("a")).alias("s"))
    assert not session.broadcast_if_small(df, max_bytes=900)[1]
