"""Quality rules, personal data and near-duplicates against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import components, crf, pii, quality_rules, queries, simhash
from spanloom.llm.words import PLAIN, SPACED, Words, chunks

SPACED_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 \t\n\x0bé #", max_size=30), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    array = pa.array(texts, pa.string())
    for kept, pattern, lower in ((SPACED, SPACED_WORDS, False), (PLAIN, PLAIN_WORDS, True)):
        words = Words(array, kept, lower)
        flat = [w for t in texts for w in pattern.findall(lowered(t) if lower else t)]
        assert words.strings().to_pylist() == flat
        assert words.counts.tolist() == [len(pattern.findall(lowered(t) if lower else t)) for t in texts]


def test_chunks_cover_all_rows():
    texts = pa.array(["x" * n for n in (5, 100, 1, 1, 300, 0)])
    assert list(chunks(texts, 120))[0][0] == 0
    assert [b for _, b in chunks(texts, 120)][-1] == 6
    assert [r for a, b in chunks(texts, 120) for r in range(a, b)] == list(range(6))


def measured(text):
    words = SPACED_WORDS.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if SPACED_WORDS.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_measurements(odd, empty):
    got = quality_rules.ledger(odd).select("row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert tuple(r[1:]) == measured(r.text)
    assert quality_rules.ledger(empty).count() == 0


def test_policies_and_ablations(spark):
    texts = ["few words", "same " * 80, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}###" for i in range(60))]
    book = quality_rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kept = {r.row.doc_id: r.kept for r in quality_rules.apply_policy(book, "v1").collect()}
    assert kept == {0: False, 1: False, 2: True, 3: False}
    assert quality_rules.apply_policy(book, "base").where("kept").count() == 2
    table = {(r.policy, r.rule): (r.n_failed, r.n_only, r.n_kept) for r in quality_rules.ablations(book).collect()}
    assert table["v1", "few_words"] == (1, 1, 1) and table["v1", "symbols"] == (1, 1, 1)
    assert table["base", "repeated_words"][0] == 1 and ("base", "symbols") not in table


def test_kept_rows_are_unchanged(odd):
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert kept.exceptAll(odd).count() == 0


KINDS = ("email", "ip", "card", "phone")
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def check_digit(digits):
    return sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def holds(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    return (
        True if kind == 0
        else all(int(p) <= 255 for p in found.split(".")) if kind == 1
        else 12 <= len(digits) <= 19 and check_digit(digits) if kind == 2
        else 9 <= len(digits) <= 15
    )


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if holds(k, m[0]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1234.@-+() %_é", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs_are_linear():
    for text in ("a" * 200000, "1" * 200000, "a@" * 50000, "1." * 100000, "+1 " * 60000):
        pii.base_spans(text)


def test_field_adds_spans(spark, odd, empty):
    text = "pay 4111111111111111 5500005555555559 now. or +1 (826) 555-4081 190.137.223.204 etc. und 2.0. see token = \"9c8b45435718d\""
    df = spark.createDataFrame([(1, text), (2, "clean words only, in 1999 version 2.0.")], "doc_id long, text string")
    got = {r.row.doc_id: r for r in pii.detect(df).collect()}
    found = {text[int(a) : int(b)] for _, a, b in (s.split(":") for s in got[1].spans.split(","))}
    assert found == {"4111111111111111", "5500005555555559", "+1 (826) 555-4081", "190.137.223.204"}
    assert got[2].spans == ""
    for r in pii.detect(odd, ["text"]).collect():
        base = plain_spans(r.row.text or "")
        said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert pii.detect(empty).count() == 0


def test_mask(spark, odd):
    df = spark.createDataFrame([(1, "mail a@b.cd or call", 19, "k"), (2, None, None, "k")], "doc_id long, text string, n_chars int, masked string")
    assert [tuple(r) for r in pii.mask(df).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] or call", 20, "k"), (2, None, None, "k")]
    assert pii.mask(odd).count() == odd.count()


def test_decoding_matches_all_paths():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 4, 3, 0, 2])
    first = np.cumsum(lengths) - lengths
    score, move, start = rng.normal(size=(10, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    import itertools

    for group in crf.batches(lengths, 8):
        at, there = crf.padded(first[group], lengths[group])
        best = crf.viterbi(score[at], there, move, start)
        marginal, _, norm = crf.forward_backward(score[at], there, move, start)
        for n, s in enumerate(group):
            size = lengths[s]
            def value(path):
                own = score[first[s] : first[s] + size][range(size), list(path)].sum()
                return start[path[0]] + own + sum(move[a, b] for a, b in zip(path, path[1:]))
            paths = list(itertools.product(range(3), repeat=int(size)))
            weights = np.exp([value(p) for p in paths])
            assert best[:size, n].tolist() == list(paths[int(weights.argmax())])
            assert np.isclose(norm[n], np.log(weights.sum()))
            for t in range(size):
                want = [weights[[p[t] == k for p in paths]].sum() / weights.sum() for k in range(3)]
                assert np.allclose(marginal[t, n], want)


def plain_print(text):
    words = SPACED_WORDS.findall(lowered(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_fingerprints_and_classes(spark, odd, empty):
    r = random.Random(7)
    base = [r.choices("abcdefghij", k=60) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate([x.text for x in odd.where("doc_id is not null").orderBy("doc_id").collect()])]
    for k, words in enumerate(base):
        for n in range(9):
            copy = list(words)
            for _ in range(n // 3):
                copy[r.randrange(60)] = "zz"
            rows.append((100 + 10 * k + n, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (int(x.fingerprint, 16), x.component_id) for x in simhash.near_duplicates(df).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id").collect()}
    prints = {i: plain_print(t) for i, t in rows}
    assert {i: v[0] for i, v in got.items()} == prints
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: v[1] for i, v in got.items()} == plain_components(links, ids)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.groupBy("doc_id").count().where("count > 1").count() == 0


def test_tree_loses_no_link(spark):
    """Clusters over many small shards, so that most links cross boundaries."""
    rng = np.random.default_rng(11)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    points = set()
    for c in centres.tolist():
        x = c
        for _ in range(60):
            for b in rng.integers(0, 63, 2).tolist():
                x ^= 1 << b
            points.add(x)
    points |= set(rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64).tolist())
    ids = sorted(points)
    df = spark.createDataFrame([(x,) for x in ids], "fp long").repartition(4)
    edges = simhash.links(df, shard=100)
    got = {r.node: r.component for r in components.components(edges).collect()}
    array = np.array(ids, np.int64).view(np.uint64)
    links = [(ids[i], ids[i + 1 + j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(array[i] ^ array[i + 1 :]) <= 2)]
    want = plain_components(links, ids)
    assert {i: got.get(i, i) for i in ids} == want
    assert edges.count() < 8 * len(ids)
    assert simhash.links(df.where("fp is null")).count() == 0


def test_shard_search_is_exact():
    rng = np.random.default_rng(2)
    home = rng.integers(0, 1 << 12, 1500, dtype=np.int64)
    a, b = simhash.shard_links(home, home[:0], 1)
    got = plain_components(list(zip(a.tolist(), b.tolist())), sorted(set(home.tolist())))
    ids = sorted(set(home.tolist()))
    want = plain_components([(x, y) for x in ids for y in ids if x < y and (x ^ y).bit_count() <= 1], ids)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups(got) == groups(want)


def test_long_chains_are_one_component(spark):
    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    odd_links = spark.createDataFrame([(500, 500), (None, 3), (300, 301), (301, 300)], "a long, b long")
    got = {r.node: r.component for r in components.components(df.union(odd_links)).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}


def test_queries_answer_for_every_row(spark, sf):
    for name in ("op2_pii_spans", "op4_quality_rules", "op5_simhash_near_dedup"):
        assert queries.QUERIES[name](spark, sf).count() == 200


def test_pii_query_against_the_patterns(spark, sf):
    """The base columns of every row of the table; the spans hold the base ones."""
    names = ["email", "ip", "card", "phone"]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.QUERIES["op2_pii_spans"](spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        base = plain_spans(texts[r.doc_id])
        said = [f"{names[k]}:{a}:{b}" for a, k, b in base]
        counts = [sum(k == i for _, k, _ in base) for i in range(4)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) or not said
