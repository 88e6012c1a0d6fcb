"""The numbered queries over the given tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import (
    bpe,
    decontaminate,
    divergence,
    fingerprints,
    html_text,
    ids_file,
    language,
    pii,
    quality_rules,
    repeats,
    simhash,
    toxicity,
    whitening,
)
from spanloom.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(_table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.BASE)) != 0
    return book.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & quality_rules.passes()).alias("kept"),
        "failed",
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"]
    )
    n_hit = decontaminate.n_hit()
    return found.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", *[c for c in found.columns if c != "row"])


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.token_digests(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(toxicity.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.score(docs, model, ["doc_id"]).select("row.doc_id", "score", "spans")
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(toxicity.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    found = language.predict(docs, language.fit(docs, ~held_out), ["doc_id"])
    return found.select("row.doc_id", "lang_pred", "score", "n_spans").withColumn("held_out", held_out)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))


def op1_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    ids_file.write_ids(_table(spark, sf_dir, "documents"), path)
    return ids_file.read_checksums(spark, path)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.audit(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return found.select("row.vec_id", *[c for c in found.columns if c != "row"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_id_files": op1_token_id_files,
    "op2_pii_spans": op2_pii_spans,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_source_divergence": op11_source_divergence,
    "op12_fingerprints": op12_fingerprints,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PLAIN = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    r" 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

#: The others hash, segment, tokenise or learn in ways SQL cannot express.
ORACLE: dict[str, str] = {
    "op4_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACED} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines,
  coalesce(n_repeat, 0) AS n_repeat_words FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN 10 * word_chars < 25 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 7 = 0 AS kept, failed FROM f""",
    "op7_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_PLAIN} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT doc_id, n, k, item_id FROM dw JOIN win USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
m AS (SELECT lang, source, sum(n) AS m FROM c GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, coalesce(m.m, 0) + 5 * v.v AS total, v.v
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN m USING (lang, source) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // total AS p, sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS lt FROM x),
q AS (SELECT *, 1 + (1000000000::HUGEINT * (ln + 5)) // (lt + 5 * v) AS q FROM p),
a AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM q a JOIN q b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(a_b.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN a a_b ON a_b.lang = a.lang AND a_b.source = a.source AND a_b.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM q WHERE n > 0 AND p > q),
f AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
SELECT * FROM f WHERE part = 'pair' OR rank <= 50""",
    "op9_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 18)) AS k FROM d)),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS i, true AS x FROM f WHERE r > 1),
t AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) FILTER (x) AS n_removed, string_agg(a, ' ' ORDER BY i) FILTER (x IS NULL) AS kept FROM t LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}
