"""From a text corpus to masked token blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.masking import mlm_mask
from spanloom.functions.spans import BOS, MASK, SEP, SPECIAL_TOKENS, wrap_special
from spanloom.functions.text import word_tokens
from spanloom.operators.pack import pack_blocks
from spanloom.operators.vocab import build_vocab, tokens_to_ids
from spanloom.session import cut_lineage
from spanloom.sources.store import feature_path, fingerprint, materialize_features
from spanloom.sources.text import read_text_corpus


def corpus_blocks(
    corpus: DataFrame,
    vocab: DataFrame,
    key: str = "seq",
    text: str = "text",
    block_size: int = 512,
    tokenize: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``block_id, ids``: packed, wrapped in markers, as vocabulary ids.

    ``tokenize`` is a column function to ``array<struct<tok,start,end>>``. Texts become
    ids first, in one pass, and are stored as such; numbers are what is counted, packed
    and shuffled.
    """
    tokens = word_tokens(text) if tokenize is None else tokenize(F.col(text))["tok"]
    rows = corpus.select(key, tokens.alias("tokens"))
    ids = cut_lineage(tokens_to_ids(rows, "tokens", vocab, out="tokens").select(key, F.col("tokens").alias("ids")))
    first, last = (F.lit(SPECIAL_TOKENS.index(t)).cast("long") for t in (BOS, SEP))
    blocks = pack_blocks(ids, F.col("ids"), key, block_size)
    return blocks.select("block_id", wrap_special(F.col("tokens"), first, last).alias("ids"))


def masked_blocks(blocks: DataFrame, seed: int, vocab_size: int) -> DataFrame:
    """``block_id, input_ids, labels`` for masked-token training."""
    specials = {t: i for i, t in enumerate(SPECIAL_TOKENS)}
    mask = mlm_mask(
        F.col("ids"),
        F.col("block_id"),
        seed,
        vocab_size,
        specials[MASK],
        [specials[BOS], specials[SEP]],
    )
    return blocks.select("block_id", mask.alias("_m")).select("block_id", "_m.*")


def corpus_vocab(corpus: DataFrame, size: int | None = None, text: str = "text") -> DataFrame:
    """The corpus' vocabulary, stored so that later jobs only read it."""
    return cut_lineage(build_vocab(corpus, word_tokens(text), size))


def blocks_from_files(
    spark: SparkSession,
    path: str | list[str],
    folder: str,
    vocab_size: int | None = None,
    block_size: int = 512,
    overwrite: bool = False,
) -> DataFrame:
    """``block_id, ids`` of text files, kept in ``folder`` and reused while files and settings last."""
    target = feature_path(
        folder, "words", block_size, "blocks", fingerprint(spark, path), vocab_size=vocab_size
    )

    def make() -> DataFrame:
        corpus = cut_lineage(read_text_corpus(spark, path))
        return corpus_blocks(corpus, corpus_vocab(corpus, vocab_size), block_size=block_size)

    return materialize_features(spark, target, make, overwrite)
