"""One query per operator, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import tables as t
from spanloom.functions import score, spans, text
from spanloom.functions.binding import once
from spanloom.functions.masking import IGNORED
from spanloom.operators import batches, concat, evaluate, hooks, order, pack, profile, rows, vocab
from spanloom.plans import corpus_blocks, long_documents, qa_features
from spanloom.session import cut_lineage, scratch_path, shared_folder
from spanloom.sources import qa, registry, store
from spanloom.sources import text as text_source

VOCAB_SIZE = 5000
NULL = "<null>"


def tidy(df: DataFrame) -> DataFrame:
    """Types that both engines print alike: bigint, rounded double, joined arrays."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), " ", NULL)
        out.append(c.alias(f.name))
    return df.select(*out)


# --- sources and sinks ---------------------------------------------------


def read_qa(spark, d):
    found = qa.read_qa(spark, t.partitioned_qa(spark, d), base="xquad")
    return tidy(found.select("seq", "lang", "context", "question", "answer", "answer_start"))


def read_squad_json(spark, d):
    return tidy(qa.read_squad_json(spark, t.nested_json(spark, d), multi_line=False))


def read_squad_json_whole(spark, d):
    return tidy(qa.read_squad_json(spark, t.whole_json(spark, d), multi_line=True))


def read_text_corpus(spark, d):
    lines = text_source.read_text_corpus(spark, t.text_files(spark, d))
    return tidy(lines.select("seq", F.col("text").alias("line")))


def split_percent(spark, d):
    return tidy(order.split_percent(t.documents(spark, d), "doc_id", 5).select("doc_id", "lang"))


def materialize_features(spark, d):
    path = store.feature_path(
        f"{shared_folder(spark)}/spanloom-checks", "words", 512, "qa", store.fingerprint(spark, f"{d}/documents.parquet"), policy="null"
    )

    def make():
        return qa_features.prepare_features(t.qa_examples(spark, d), max_length=512)

    store.materialize_features(spark, path, make, overwrite=True)
    return tidy(store.materialize_features(spark, path, make))


def metrics_report(spark, d):
    scored = evaluate.score_answers(t.qa_predictions(spark, d))
    metrics = evaluate.squad_eval(scored).drop("n", "n_unscored")
    return tidy(store.metrics_report(metrics))


# --- projections and filters ---------------------------------------------


def format_trivia(spark, d):
    return tidy(rows.format_trivia(t.trivia_rows(spark, d)))


def filter_nonempty(spark, d):
    flat = rows.format_trivia(t.trivia_rows(spark, d))
    return tidy(rows.filter_nonempty(flat).select("doc_id", F.length("context").alias("n_chars")))


def filter_length_budget(spark, d):
    flat = rows.format_trivia(t.trivia_rows(spark, d))
    return tidy(rows.filter_length_budget(flat).select("doc_id", "question"))


def _labelled(spark, d, policy="null", max_length=512):
    noisy = t.qa_noisy(spark, d).withColumn(
        "answers",
        F.struct(F.array("answer").alias("text"), F.array("answer_start").alias("answer_start")),
    )
    return qa_features.label_spans(
        noisy.select("seq", "lang", "context", "question", "answers"), max_length, policy
    )


def filter_valid_spans(spark, d):
    kept = rows.filter_valid_spans(_labelled(spark, d))
    return tidy(kept.select("seq", "lang", "start_positions", "end_positions"))


def feature_view(spark, d):
    made = qa_features.prepare_features(t.qa_examples(spark, d), max_length=512)
    return tidy(rows.feature_view(made, "seq"))


def _evaluated(spark, d):
    return hooks.evaluate_rows(rows.format_trivia(t.trivia_rows(spark, d)))


def wrong_answers(spark, d):
    wrong = evaluate.wrong_answers(_evaluated(spark, d)).select("doc_id", "output", "norm_target")
    # Indexing reads its input several times; scoring should run once.
    return tidy(order.row_index(cut_lineage(wrong), "doc_id"))


def head_rows(spark, d):
    first = order.head_rows(t.documents(spark, d), "doc_id", 3)
    return tidy(first.select("doc_id", F.substring("text", 1, 333).alias("opening")))


# --- row order -----------------------------------------------------------


def row_index(spark, d):
    return tidy(order.row_index(t.qa_rows(spark, d).select("seq", "lang", "answer"), "seq"))


def dedup_runs(spark, d):
    kept = order.dedup_runs(t.qa_rows(spark, d), "seq", "context", by=["lang"])
    return tidy(kept.select("lang", "seq", "idx", "context"))


def span_groups(spark, d):
    indexed = order.row_index(t.qa_rows(spark, d).select("seq", "lang"), "seq", by=["lang"])
    group = order.span_group("idx", 3)
    return tidy(indexed.select("seq", "idx", (group * 3).alias("low"), (group * 3 + 3).alias("high")))


def concat_contexts(spark, d):
    joined = concat.concat_contexts(t.qa_examples(spark, d), 3, by=["lang"])
    return tidy(
        joined.select(
            "lang", "seq", "idx", "group_id", "context", "question",
            F.get("answers.text", 0).alias("answer"),
            F.get("answers.answer_start", 0).alias("answer_start"),
        )
    )


def rebase_answer_start(spark, d):
    moved = concat.rebase_answer_start(t.qa_examples(spark, d), 3, by=["lang"])
    return tidy(moved.select("lang", "seq", "idx", "new_start"))


def join_group_context(spark, d):
    return tidy(concat.join_group_context(t.qa_rows(spark, d), 3, by=["lang"]))


def pack_blocks(spark, d):
    blocks = pack.pack_blocks(
        t.documents(spark, d).select("doc_id", "text"), F.split("text", " "), "doc_id", 128, 2
    )
    return tidy(blocks.select("block_id", F.size("tokens").alias("n_tokens"), "tokens"))


def shuffle_seeded(spark, d):
    return tidy(batches.shuffle_seeded(t.qa_rows(spark, d).select("seq", "lang"), "seq", 42))


def make_batches(spark, d):
    stacked = batches.make_batches(t.qa_rows(spark, d), 16, ["seq", "answer_start"], "seq")
    return tidy(stacked)


# --- text and spans ------------------------------------------------------


def normalize_answer(spark, d):
    docs = t.documents(spark, d)
    return tidy(docs.select("doc_id", text.normalize_answer("text").alias("normal")))


def answer_tokens(spark, d):
    words = text.answer_tokens("text")
    return tidy(t.documents(spark, d).select("doc_id", F.size(words).alias("n"), words.alias("words")))


def token_f1(spark, d):
    pairs = t.dialog_pairs(spark, d).withColumn("pair", F.struct("conv_id", "turn"))
    f1 = evaluate.token_f1_long(pairs, "pair", "question", "answer")
    return tidy(f1.select("pair.*", "n_pred", "n_gold", "shared", "f1"))


def exact_match(spark, d):
    p = t.qa_predictions(spark, d)
    return tidy(p.select("seq", score.exact_match(F.col("pred"), F.get("golds", 0)).alias("em")))


def best_over_golds(spark, d):
    scored = evaluate.score_answers(t.qa_predictions(spark, d))
    return tidy(scored.select("seq", "em", "f1"))


def align_answer(spark, d):
    span = spans.align_answer("context", "answer", "answer_start")
    return tidy(t.qa_noisy(spark, d).select("seq", span.alias("s")).select("seq", "s.start", "s.end"))


def align_answer_ci(spark, d):
    low = t.qa_noisy(spark, d).withColumn("answer", F.lower("answer"))
    span = spans.align_answer_ci("context", "answer", "answer_start")
    return tidy(low.select("seq", span.alias("s")).select("seq", "s.start", "s.end"))


def tokenize_offsets(spark, d):
    """Every document; each eleventh one has no text, each thirteenth an empty one."""
    rows_ = t.documents(spark, d).select("doc_id", t.sparse_text().alias("text"))
    found = once(rows_, tokens=text.tokenize_offsets("text"))
    return tidy(
        found.select(
            "doc_id",
            F.size("tokens").alias("n_tokens"),
            F.col("tokens.tok").alias("tok"),
            F.col("tokens.start").alias("starts"),
            F.col("tokens.end").alias("ends"),
        )
    )


def _encoded(spark, d):
    pair = spans.encode_pair(text.word_tokens("question"), text.word_tokens("context"), 128)
    return t.qa_rows(spark, d).withColumn("e", pair)


def encode_pair(spark, d):
    return tidy(_encoded(spark, d).select("seq", "e.*"))


def encode_pair_context_first(spark, d):
    pair = spans.encode_pair(text.word_tokens("context"), text.word_tokens("question"), 128)
    return tidy(t.qa_rows(spark, d).select("seq", pair.alias("e")).select("seq", "e.input"))


def span_to_tokens(spark, d):
    found = _encoded(spark, d).withColumn(
        "s", spans.align_answer("context", "answer", "answer_start")
    )
    at = spans.span_to_tokens(F.col("context"), F.col("s"), F.col("e.input"))
    return tidy(found.select("seq", at.alias("p")).select("seq", "p.start", "p.end"))


def span_policy(spark, d):
    """All four policies next to each other; the last one with the context first."""
    base = _encoded(spark, d).withColumn(
        "s", spans.align_answer("context", "answer", "answer_start")
    )
    second = spans.span_to_tokens(F.col("context"), F.col("s"), F.col("e.input"))
    kept, _ = spans.pair_sizes(text.word_tokens("context"), text.word_tokens("question"), 128)
    first = spans.span_to_tokens_first(F.col("context"), F.col("s"), kept)
    placed = base.select("seq", second.alias("b"), first.alias("a"))
    out = [F.col("seq")]
    for policy in spans.POLICIES:
        p = F.col("a") if policy == "fill_max" else F.col("b")
        both = spans.span_policy(p["start"], p["end"], policy, 128)
        out += [
            both["start_positions"].alias(f"{policy}_start"),
            both["end_positions"].alias(f"{policy}_end"),
        ]
    return tidy(placed.select(*out))


def build_vocab(spark, d):
    return tidy(vocab.build_vocab(t.documents(spark, d), text.word_tokens("text"), VOCAB_SIZE))


def _vocab(spark, d):
    """All words, so that ids cover the corpus."""
    return corpus_blocks.corpus_vocab(t.documents(spark, d))


def _ids_tokens(spark, d, **bound):
    v = _vocab(spark, d)
    docs = t.documents(spark, d).select("doc_id", text.word_tokens("text").alias("words"))
    ids = vocab.tokens_to_ids(docs, "words", v, "doc_id", out="words", **bound).withColumnRenamed("words", "ids")
    return tidy(vocab.ids_to_tokens(ids, "ids", v, "doc_id", **bound).select("doc_id", "ids", "tokens"))


def ids_tokens(spark, d):
    return _ids_tokens(spark, d)


def ids_tokens_joined(spark, d):
    """The way of a vocabulary beyond the broadcast bound."""
    return _ids_tokens(spark, d, max_rows=0)


def vocab_lookup(spark, d):
    return _vocab_lookup(spark, d)


def vocab_lookup_salted(spark, d):
    """The way of a vocabulary beyond the broadcast bound."""
    return _vocab_lookup(spark, d, max_rows=0)


def _vocab_lookup(spark, d, **bound):
    tokens = t.documents(spark, d).select("doc_id", F.posexplode(text.word_tokens("text")).alias("pos", "token"))
    found = vocab.vocab_lookup(tokens, _vocab(spark, d), ["doc_id", "pos"], **bound)
    return tidy(
        found.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n_tokens"),
            F.count_if(F.col("token_id") == 3).alias("n_unknown"),
            F.sum(F.col("token_id") * (F.col("pos") + 1)).alias("checksum"),
        )
    )


def _blocks(spark, d):
    return corpus_blocks.corpus_blocks(
        t.documents(spark, d), _vocab(spark, d), key="doc_id", block_size=512
    )


def wrap_special(spark, d):
    """The corpus in wrapped blocks of vocabulary ids."""
    return tidy(_blocks(spark, d))


def mlm_mask(spark, d):
    v = _vocab(spark, d)
    blocks = corpus_blocks.corpus_blocks(t.documents(spark, d), v, key="doc_id", block_size=512)
    masked = corpus_blocks.masked_blocks(blocks, 42, v.count())
    chosen = F.size(F.filter("labels", lambda x: x != IGNORED))
    return tidy(masked.withColumn("n_chosen", chosen))


def extract_span(spark, d):
    s = t.span_scores(spark, d)
    answer = spans.extract_span("tokens", "start_scores", "end_scores")
    return tidy(
        s.select(
            "vec_id",
            spans.argmax("start_scores").alias("start"),
            spans.argmax("end_scores").alias("end"),
            answer.alias("answer"),
        )
    )


def clean_output(spark, d):
    docs = t.documents(spark, d)
    quoted = F.concat(F.lit(' "'), F.col("text"), F.lit('"'))
    return tidy(docs.select("doc_id", score.clean_output(quoted).alias("output")))


def alias_match(spark, d):
    flat = rows.format_trivia(t.trivia_rows(spark, d))
    guess = F.substring_index("context", " ", 1)
    return tidy(
        flat.select("doc_id", score.alias_match(guess, "targets", "norm_target").alias("match"))
    )


# --- joins and aggregates ------------------------------------------------


def align_predictions(spark, d):
    refs = t.qa_rows(spark, d).select("seq", "answer")
    preds = t.qa_predictions(spark, d).select((F.col("seq") + 1).alias("seq"), "pred")
    return tidy(evaluate.align_predictions(refs, preds, "seq"))


def label_languages(spark, d):
    counts = t.documents(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return tidy(registry.label_languages(counts, registry.languages(spark, "xquad")))


def squad_eval(spark, d):
    return tidy(evaluate.squad_eval(evaluate.score_answers(t.qa_predictions(spark, d))))


def squad_eval_by_lang(spark, d):
    refs = t.qa_rows(spark, d)
    preds = t.qa_predictions(spark, d).select("seq", "pred")
    return tidy(qa_features.evaluate_predictions(refs, preds))


def alias_accuracy(spark, d):
    return tidy(long_documents.accuracy(long_documents.select_documents(t.trivia_rows(spark, d), "doc_id")))


def binary_metrics(spark, d):
    docs = t.documents(spark, d).select("doc_id", "n_chars")
    long_enough = (F.col("n_chars") >= 500).cast("double")
    logits = t.table(spark, d, "labels").join(docs, "doc_id").select(
        F.array(1 - long_enough, long_enough).alias("logits"), F.col("quality").alias("label")
    )
    return tidy(evaluate.binary_metrics(logits))


def bits_per_token(spark, d):
    counts = (
        t.documents(spark, d)
        .select(F.explode(F.split("text", " ")).alias("tok"))
        .groupBy("tok")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return tidy(evaluate.unigram_bits(counts))


def span_stats(spark, d):
    return tidy(profile.span_stats(rows.filter_valid_spans(_labelled(spark, d))))


def length_profile(spark, d):
    n = F.regexp_count("text", F.lit(r"\S+"))
    return tidy(profile.length_profile(t.documents(spark, d), n))


def row_lengths(spark, d):
    measured = profile.row_lengths(t.qa_rows(spark, d))
    return tidy(measured.select("seq", "question_length", "context_length"))


def concat_fit(spark, d):
    n = F.regexp_count("context", F.lit(r"\S+"))
    return tidy(profile.concat_fit(t.qa_rows(spark, d), n))


def row_audit(spark, d):
    return tidy(
        profile.row_audit(_labelled(spark, d, max_length=128), qa_features.rejection_reason(128))
    )


def audit_preparation(spark, d):
    """Rows before and after the preparation of long inputs, by reason."""
    return tidy(qa_features.audit_preparation(t.qa_examples(spark, d), 3, max_length=512))


def union_languages(spark, d):
    """All languages of the corpus, whichever there are, in one scan."""
    rows_ = qa.read_qa(spark, t.partitioned_qa(spark, d), base="xquad")
    return tidy(rows_.select("seq", "doc_id", "lang", F.col("context").alias("text")))


# --- user code -----------------------------------------------------------


def map_rows(spark, d):
    docs = t.documents(spark, d).select("doc_id", "text")
    return tidy(
        hooks.map_rows(
            docs, lambda p: p.assign(n_words=p["text"].str.split(" ").str.len())[["doc_id", "n_words"]],
            "doc_id long, n_words long",
        )
    )


def filter_rows(spark, d):
    docs = t.documents(spark, d).select("doc_id", "lang", "text")
    return tidy(hooks.filter_rows(docs, lambda s: s.str.contains("\n"), "text").select("doc_id", "lang"))


def score_spans(spark, d):
    """Built-in overlap scores for every row."""
    scored = hooks.overlap_scores(t.qa_rows(spark, d).withColumn("tokens", text.word_tokens("context")))
    return tidy(scored.select("seq", F.transform("start_scores", lambda x: x.cast("int")).alias("start_scores")))


def score_spans_model(spark, d):
    """Scores from a user's batch function."""

    def make_model():
        def predict(vectors):
            return {"start_scores": vectors, "end_scores": vectors[:, ::-1]}

        return predict

    vec = t.table(spark, d, "embeddings").select(
        "vec_id", "embedding", F.transform("embedding", lambda _, i: i.cast("string")).alias("tokens")
    )
    width = [[64]]
    scored = hooks.score_spans(vec, make_model, "embedding", shapes=width)
    answer = spans.extract_span("tokens", "start_scores", "end_scores")
    return tidy(scored.select("vec_id", answer.alias("answer")))


def distributed_eval(spark, d):
    return tidy(_evaluated(spark, d).select("doc_id", "output", "match"))


def prepare_long_features(spark, d):
    """Concatenation, repair, encoding and labels in one plan."""
    made = qa_features.prepare_features(t.qa_examples(spark, d), nr_concats=3, max_length=2048)
    return tidy(made.select("seq", "lang", "start_positions", "end_positions",
                            F.size(F.array_remove("attention_mask", 0)).alias("n_used")))


def _joined(spark, d):
    return concat.concat_contexts(t.qa_examples(spark, d), 3, by=["lang"])


def label_long_spans(spark, d):
    """Labels of long inputs under two policies; the limit follows the length."""
    made = qa_features.label_spans(_joined(spark, d), max_length=2048, policy=("null_zero", "fill_max"))
    return tidy(
        made.select(
            "seq",
            *[F.col(f"{p}_{x}_positions").alias(f"{p}_{x}") for p in ("null_zero", "fill_max") for x in ("start", "end")],
        )
    )


def trivia_training_batches(spark, d, tokenize=None):
    """Repair against the lower-cased context, context first, shuffled, in batches."""
    low = t.qa_noisy(spark, d).select(
        "seq", "context", "question",
        F.struct(
            F.array(F.lower("answer")).alias("text"), F.array("answer_start").alias("answer_start")
        ).alias("answers"),
    )
    made = long_documents.training_batches(low, 256, 16, 42, tokenize=tokenize)
    return tidy(
        made.select(
            "batch_id", "n_rows", "seq", "start_positions", "end_positions",
            F.transform("input_ids", lambda x: F.array_join(x, " ")).alias("input_ids"),
        )
    )


def trivia_training_batches_custom(spark, d):
    """The same through a user's tokenizer of whole Arrow batches."""
    def words(texts):
        import numpy as np
        import pyarrow as pa

        texts = texts.cast(pa.large_string())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        # runs of bytes that are no white space, cut where a text ends
        inside = np.append((data != 32) & ((data < 9) | (data > 13)), False)
        before = np.roll(inside, 1)
        before[edges] = False
        begin = np.flatnonzero(inside & ~before)
        after = inside[1:].copy()
        after[edges[1:][edges[1:] > 0] - 1] = False
        end = np.flatnonzero(inside[:-1] & ~after) + 1
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first = np.searchsorted(begin, edges)
        base = np.repeat(chars[edges[:-1]], np.diff(first))
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        kept = data[inside[:-1]]
        found = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))
        return found.cast(pa.string()), chars[begin] - base, chars[end] - base, first

    return trivia_training_batches(spark, d, text.flat_tokenizer(words))


def evaluate_model_report(spark, d):
    """From scores to a report file, read back."""
    results = qa_features.evaluate_model(t.qa_rows(spark, d), "xquad")
    path = scratch_path(spark, "report")
    store.write_report(qa_features.report_of(results), path)
    return tidy(store.read_report(spark, path))


def evaluate_model_datasets(spark, d):
    """From scores to results per dataset and language, with their labels."""
    rows = t.qa_rows(spark, d).withColumn("dataset", F.when(F.col("doc_id") % 3 == 0, "mlqa").otherwise("xquad"))
    found = qa_features.evaluate_model(rows, ["xquad", "mlqa"], dataset="dataset")
    return tidy(found.select("dataset", "lang", "label", "exact_match", "f1", "n"))


def count_over_budget(spark, d):
    """How many long documents a length budget would leave out."""
    return tidy(long_documents.over_budget(rows.format_trivia(t.trivia_rows(spark, d))))


def row_index_text(spark, d):
    """Positions by a text key."""
    named = t.qa_rows(spark, d).select(F.concat(F.lit("q"), F.col("seq").cast("string")).alias("id"), "lang")
    return tidy(order.row_index(cut_lineage(named), "id"))


def pack_blocks_long(spark, d):
    """Blocks of 4,096 out of texts of one word each."""
    words = t.documents(spark, d).select(
        F.posexplode(F.split("text", " ")).alias("pos", "w"), "doc_id"
    ).select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("key"), "w")
    blocks = pack.pack_blocks(words, F.array("w"), "key", 4096, 2)
    return tidy(blocks.select("block_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("md5")))


def make_batches_large(spark, d):
    stacked = batches.make_batches(t.qa_rows(spark, d).select("seq", "answer_start"), 2000, ["seq", "answer_start"], "seq")
    return tidy(stacked)


def read_qa_configs(spark, d):
    """One folder per language, read in one scan."""
    langs = ["de", "en", "es", "fr"]
    found = qa.read_qa_configs(spark, t.qa_folders(spark, d, langs), "xquad", langs)
    return tidy(found.select("seq", "lang", "context", "question", "answer", "answer_start"))


def blocks_from_files(spark, d):
    """From text files to stored blocks of ids."""
    folder = f"{shared_folder(spark)}/spanloom-checks"
    return tidy(corpus_blocks.blocks_from_files(spark, t.text_files(spark, d), folder, overwrite=True))


def row_at(spark, d):
    """The row at a position."""
    indexed = order.row_index(t.qa_rows(spark, d).select("seq", "lang", "answer"), "seq")
    return tidy(order.row_at(indexed, 333))


#: Words and single other characters: answers then end inside words and at punctuation.
PIECE = r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r]"


def extract_span_pieces(spark, d):
    """Answers cut out of the context by parts of words, with what stands between them."""
    n = F.size("pieces")
    start = (F.col("doc_id") * 7) % n
    end = start + F.when(F.col("doc_id") % 4 == 0, -1).otherwise(F.col("doc_id") % 9)
    made = once(t.documents(spark, d), pieces=text.tokenize_offsets("text", PIECE)).where(n > 0)

    def peak(at):
        return F.transform("pieces", lambda _, i: -F.abs(i - at).cast("double"))

    made = made.select("doc_id", "text", "pieces", peak(start).alias("s"), peak(end).alias("e"))
    return tidy(made.select("doc_id", spans.extract_span_text("text", "pieces", "s", "e").alias("answer")))


QUERIES = {
    f.__name__: f
    for f in (
        read_qa, read_squad_json, read_squad_json_whole, read_text_corpus, split_percent, materialize_features,
        metrics_report,
        format_trivia, filter_nonempty, filter_length_budget, filter_valid_spans, feature_view,
        wrong_answers, head_rows,
        row_index, dedup_runs, span_groups, concat_contexts, rebase_answer_start,
        join_group_context, pack_blocks, shuffle_seeded, make_batches,
        normalize_answer, answer_tokens, token_f1, exact_match, best_over_golds, align_answer,
        align_answer_ci, tokenize_offsets, encode_pair, encode_pair_context_first, span_to_tokens,
        span_policy, ids_tokens, wrap_special, extract_span, clean_output, alias_match, mlm_mask,
        align_predictions, label_languages, vocab_lookup,
        squad_eval, squad_eval_by_lang, alias_accuracy, binary_metrics, bits_per_token, span_stats,
        length_profile, row_lengths, concat_fit, row_audit, audit_preparation, build_vocab,
        union_languages,
        map_rows, filter_rows, score_spans, score_spans_model, distributed_eval,
        prepare_long_features, label_long_spans, trivia_training_batches,
        trivia_training_batches_custom, evaluate_model_report, count_over_budget, row_index_text,
        pack_blocks_long, make_batches_large, ids_tokens_joined, vocab_lookup_salted,
        read_qa_configs, blocks_from_files, row_at, extract_span_pieces, evaluate_model_datasets,
    )
}
