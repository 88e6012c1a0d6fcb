"""Which languages each QA corpus has, and the labels used in reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.session import broadcast_if_small

# Languages of the public multilingual QA corpora, and names.
XQUAD_LANGS = ["ar", "de", "el", "en", "es", "hi", "ru", "th", "tr", "vi", "zh"]
MLQA_LANGS = ["ar", "de", "en", "es", "hi", "vi", "zh"]
LANGUAGE_NAMES = {
    "ar": "Arabic", "de": "German", "el": "Greek", "en": "English", "es": "Spanish",
    "fr": "French", "hi": "Hindi", "ru": "Russian", "th": "Thai", "tr": "Turkish",
    "vi": "Vietnamese", "zh": "Chinese",
}
CORPORA = {"squad": ["en"], "xquad": XQUAD_LANGS, "mlqa": MLQA_LANGS}
TITLES = {"squad": "SQuAD 1.1", "xquad": "XQuAD", "mlqa": "MLQA"}


def config_name(base: str, lang: str) -> str:
    """Name of one language's table: ``base.lang``, doubled language for ``mlqa``."""
    return f"{base}.{lang}.{lang}" if base == "mlqa" else f"{base}.{lang}"


def label(base: str, lang: str) -> str:
    """Report label of one language of a corpus."""
    if base == "squad":
        return f"{TITLES[base]} validation dataset"
    return f"{TITLES.get(base, base)} {LANGUAGE_NAMES.get(lang, lang)} validation"


def languages(spark: SparkSession, base: str, langs: list[str] | None = None) -> DataFrame:
    """``lang, label`` of a corpus, one row per language."""
    rows = [(lang, label(base, lang)) for lang in (langs or CORPORA[base])]
    return spark.createDataFrame(rows, "lang string, label string")


def label_languages(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds the label by language code; unknown codes get NULL."""
    side, _ = broadcast_if_small(dim)
    return df.join(side, "lang", "left")
