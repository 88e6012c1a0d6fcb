"""QA corpora: per-language tables and nested JSON files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.nested import read_elements
from spanloom.sources.registry import config_name

# Layout of nested QA files.
ARTICLE = (
    "paragraphs array<struct<context string, qas array<struct<"
    "question string, answers array<struct<text string, answer_start int>>>>>>"
)
NESTED_SCHEMA = f"data array<struct<{ARTICLE}>>"


def read_qa(
    spark: SparkSession,
    path: str,
    langs: Sequence[str] | None = None,
    base: str | None = None,
    split: str = "validation",
    fmt: str = "parquet",
) -> DataFrame:
    """Rows of the wanted languages and split from a table partitioned by
    ``dataset, lang, split``; other partitions are not read.

    Without ``langs`` all languages are read, in one scan. Without ``base`` the
    entries of ``langs`` are whole datasets.
    """
    table = spark.read.format(fmt).load(path).where(F.col("split") == split)
    if langs is None:
        return table if base is None else table.where(F.col("dataset") == base)
    if base is None:
        return table.where(F.col("dataset").isin(list(langs)))
    return table.where((F.col("dataset") == base) & F.col("lang").isin(list(langs)))


def read_qa_configs(
    spark: SparkSession,
    root: str,
    base: str,
    langs: Sequence[str],
    split: str = "validation",
    fmt: str = "parquet",
) -> DataFrame:
    """As ``read_qa`` for one folder per language, ``root/<config name>/<split>``.

    All folders are one scan; a row's language follows from the path of its file.
    """
    folders = {config_name(base, lang): lang for lang in langs}
    if not folders:
        raise ValueError("langs must not be empty")
    table = spark.read.format(fmt).load([f"{root.rstrip('/')}/{name}/{split}" for name in folders])
    # the folder above the split; a path is percent-encoded where its names need it
    name = F.url_decode(F.element_at(F.split(F.regexp_extract(F.col("_metadata.file_path"), f"^(.*)/{re.escape(split)}/", 1), "/"), -1))
    known = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
    return table.withColumn("lang", known[name])


def write_qa(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Stores QA rows so that ``read_qa`` can prune by dataset, language and split."""
    df.write.mode(mode).partitionBy("dataset", "lang", "split").parquet(path)


def union_languages(tables: dict[str, DataFrame]) -> DataFrame:
    """One table with a ``lang`` column from one table per language."""
    tagged = [df.withColumn("lang", F.lit(lang)) for lang, df in tables.items()]
    return reduce(DataFrame.unionByName, tagged)


def read_squad_json(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """``context, question, text, answer_start``, one row per answer.

    Questions without answers vanish. Files have one object per line; a file that is
    one object over several lines needs ``multi_line`` and is read by byte ranges.
    """
    if multi_line:
        articles = read_elements(spark, path, "data", ARTICLE).select(F.col("element").alias("d"))
    else:
        articles = spark.read.schema(NESTED_SCHEMA).json(path).select(F.explode("data").alias("d"))
    return (
        articles.select(F.explode("d.paragraphs").alias("p"))
        .select(F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
        .select("context", F.col("q.question").alias("question"), F.explode("q.answers").alias("a"))
        .select("context", "question", F.col("a.text").alias("text"), F.col("a.answer_start").alias("answer_start"))
    )
