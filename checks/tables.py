"""Inputs of the check queries, derived from the given tables by Spark."""

from __future__ import annotations

import hashlib
from pathlib import Path
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import shared_folder
from spanloom.sources.store import fingerprint, materialize_features


#: Bytes of text in a file that one task writes.
JSON_FILE = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, source: str, name: str) -> str:
    """Folder for data written by a check, one per content of ``source`` and of this file."""
    version = hashlib.md5(Path(__file__).read_bytes()).hexdigest()[:8]
    key = f"{fingerprint(spark, f'{sf_dir}/{source}.parquet')}-{version}"
    return f"{shared_folder(spark)}/spanloom-checks/{name}-{key}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sparse_text():
    """The text, missing or empty for some documents."""
    doc = F.col("doc_id")
    return F.when(doc % 11 == 0, F.lit(None)).when(doc % 13 == 0, F.lit("")).otherwise(F.col("text"))


def qa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three questions per document; the answer is a word of the text."""
    words = F.split("text", " ")

    def answer(q):
        at = (F.col("doc_id") * 7 + q * 3) % F.size("w")
        before = F.slice("w", F.lit(1), at.cast("int"))
        return (
            F.get("w", at.cast("int")),
            F.length(F.array_join(before, " ")) + F.when(at > 0, 1).otherwise(0),
        )

    rows = (
        documents(spark, sf_dir)
        .select("doc_id", "lang", "source", "text", words.alias("w"))
        .withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3)))
    )
    text, start = answer(F.col("q"))
    following, _ = answer(F.col("q") + 1)
    golds = F.when(F.col("q") < F.col("doc_id") % 3, F.array(text, following)).otherwise(
        F.array(text)
    )
    return rows.select(
        (F.col("doc_id") * 4 + F.col("q")).alias("seq"),
        "doc_id",
        "lang",
        F.col("source").alias("title"),
        F.col("text").alias("context"),
        F.concat(F.lit("where is "), text, F.lit(" in "), F.col("source"), F.lit(" ?")).alias(
            "question"
        ),
        text.alias("answer"),
        start.cast("int").alias("answer_start"),
        golds.alias("golds"),
    )


def qa_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows above as a QA corpus with an ``answers`` struct."""
    return qa_rows(spark, sf_dir).select(
        "seq",
        "doc_id",
        "lang",
        "title",
        "context",
        "question",
        F.struct(
            F.array("answer").alias("text"), F.array("answer_start").alias("answer_start")
        ).alias("answers"),
    )


def qa_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer starts that are off by up to three characters."""
    return qa_rows(spark, sf_dir).withColumn(
        "answer_start", (F.col("answer_start") + F.col("doc_id") % 4).cast("int")
    )


def qa_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right, dressed up, padded, wrong and empty answers in turn.

    Upper case is limited to ASCII, as engines differ on the sharp s.
    """
    kind = F.col("doc_id") % 5
    a = F.col("answer")
    pred = (
        F.when(kind == 0, a)
        .when(kind == 1, F.concat(F.translate(a, ascii_lowercase, ascii_uppercase), F.lit("!")))
        .when(kind == 2, F.concat(F.lit("the "), a, F.lit(" "), a, F.lit(" extra")))
        .when(kind == 3, F.substring(F.col("context"), F.col("answer_start") + 1, F.lit(40)))
        .otherwise("")
    )
    return qa_rows(spark, sf_dir).select("seq", "doc_id", "lang", pred.alias("pred"), "golds")


def dialog_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the assistant's next one."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id", "turn", (F.col("turn") + 1).alias("next"), F.col("text").alias("question")
    )
    told = turns.where("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("next"), F.col("text").alias("answer")
    )
    return asked.join(told, ["conv_id", "next"]).select("conv_id", "turn", "question", "answer")


def trivia_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a long-document question about its first word."""
    first = F.get(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 0)
    return documents(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("which "), first).alias("question"),
        F.col("doc_id").cast("string").alias("question_id"),
        F.col("source").alias("question_source"),
        F.struct(F.split("text", "\n").alias("wiki_context")).alias("entity_pages"),
        F.array().cast("array<string>").alias("search_results"),
        F.struct(
            F.array(F.concat(first, F.lit(".")), F.lower(first)).alias("aliases"),
            F.lower(first).alias("normalized_value"),
        ).alias("answer"),
    )


def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score vectors; the end scores are the start scores reversed."""
    vec = table(spark, sf_dir, "embeddings")
    return vec.select(
        "vec_id",
        F.transform("embedding", lambda _, i: F.concat(F.lit("t"), i.cast("string"))).alias("tokens"),
        F.col("embedding").alias("start_scores"),
        F.reverse("embedding").alias("end_scores"),
    )


def partitioned_qa(spark: SparkSession, sf_dir: str) -> str:
    """The QA corpus written by dataset, language and split."""
    from spanloom.sources.qa import write_qa

    path = stored(spark, sf_dir, "documents", "qa")

    def write():
        rows = qa_rows(spark, sf_dir).withColumn("dataset", F.lit("xquad"))
        write_qa(rows.withColumn("split", F.lit("validation")), f"{path}/rows", "overwrite")
        return spark.range(1)

    materialize_features(spark, f"{path}/log", write)
    return f"{path}/rows"


def qa_folders(spark: SparkSession, sf_dir: str, langs: list[str]) -> str:
    """The QA corpus in one folder per language."""
    from spanloom.sources.registry import config_name

    path = stored(spark, sf_dir, "documents", "qa-folders")

    def write():
        rows = qa_rows(spark, sf_dir)
        for lang in langs:
            folder = f"{path}/rows/{config_name('xquad', lang)}/validation"
            rows.where(F.col("lang") == lang).drop("lang").write.mode("overwrite").parquet(folder)
        return spark.range(1)

    materialize_features(spark, f"{path}/log", write)
    return f"{path}/rows"


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``paragraphs`` of one article per document, with a question that has no answers."""
    qas = F.struct(
        "question",
        F.array(F.struct(F.col("answer").alias("text"), F.col("answer_start"))).alias("answers"),
    )
    per_document = qa_rows(spark, sf_dir).groupBy("doc_id").agg(
        F.first("context").alias("context"), F.collect_list(qas).alias("qas")
    )
    bare = F.struct(
        F.lit("nobody knows").alias("question"),
        F.array().cast("array<struct<text:string,answer_start:int>>").alias("answers"),
    )
    paragraph = F.struct("context", F.array_append("qas", bare).alias("qas"))
    return per_document.select("doc_id", F.array(paragraph).alias("paragraphs"))


def nested_json(spark: SparkSession, sf_dir: str) -> str:
    """The QA corpus as nested JSON, one object per document."""
    path = stored(spark, sf_dir, "documents", "json")

    def write():
        objects = _articles(spark, sf_dir).select(F.array(F.struct("paragraphs")).alias("data"))
        objects.write.mode("overwrite").json(f"{path}/files")
        return spark.range(1)

    materialize_features(spark, f"{path}/log", write)
    return f"{path}/files"


def whole_json(spark: SparkSession, sf_dir: str) -> str:
    """The QA corpus as eight files or more, each of them one JSON object over many lines.

    Files have some ``JSON_FILE`` bytes of text at most, as one task writes one.
    """
    path = stored(spark, sf_dir, "documents", "json-whole")

    def write():
        size = documents(spark, sf_dir).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(8, -(-size // JSON_FILE))
        text = F.regexp_replace(F.to_json(F.struct("paragraphs")), '"(context|qas|question)":', '\n  "$1":\n    ')
        lines = _articles(spark, sf_dir).select(
            F.pmod("doc_id", F.lit(files)).alias("part"), F.col("doc_id").alias("o"), F.concat(F.lit("  , "), text).alias("value")
        )
        ends = spark.range(files).select(F.col("id").alias("part"), F.explode(F.array(F.lit(-1), F.lit(2**62)).cast("array<long>")).alias("o"))
        head = '{\n  "meta": {"data": ["}", "{"]},\n  "data": [\n  {"paragraphs": []}'
        ends = ends.withColumn("value", F.when(F.col("o") < 0, F.lit(head)).otherwise(F.lit('],\n  "version": "1.1"\n}')))
        whole = lines.unionByName(ends).repartition(files, "part").sortWithinPartitions("part", "o")
        whole.select("part", "value").write.mode("overwrite").partitionBy("part").text(f"{path}/files")
        return spark.range(1)

    materialize_features(spark, f"{path}/log", write)
    return f"{path}/files"


def text_files(spark: SparkSession, sf_dir: str) -> str:
    """All documents as text files, in document order."""
    path = stored(spark, sf_dir, "documents", "text")

    def write():
        documents(spark, sf_dir).orderBy("doc_id").select("text").write.mode("overwrite").text(
            f"{path}/files"
        )
        return spark.range(1)

    materialize_features(spark, f"{path}/log", write)
    return f"{path}/files"
