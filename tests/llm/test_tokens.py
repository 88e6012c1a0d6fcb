"""Tokens, token files, decontamination and repeated passages against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import bpe, decontaminate, id_coder, ids_file, queries, repeats
from tests.llm.test_text_rules import PLAIN_WORDS, SPACED_WORDS, lowered

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OWN = bpe.Bpe(bpe.default_path())
ALPHABET = "ab  \n\t'st1é中  　\x1c\x85\U0001f600<|>.,A_"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=60), max_size=6))
def test_ids_are_those_of_the_library(texts):
    texts = [*texts, "<|endoftext|>" + "".join(texts) + "<|endoftext|>"]
    ids, at = OWN.encode(pa.array(texts, pa.string()))
    decoded = OWN.decode(ids, at)
    for k, text in enumerate(texts):
        want = library(text)
        assert ids[at[k] : at[k + 1]].tolist() == want
        assert decoded[k].decode() == LIBRARY.decode(want, skip_special_tokens=False) == text


def test_one_long_piece():
    for text in ("the" * 20000, "ab" * 31 + "c", "x" * 64, "x" * 65, " " * 400):
        ids, _ = OWN.encode(pa.array([text]))
        assert ids.tolist() == library(text)


def test_token_digests(odd, empty):
    rows = bpe.token_digests(odd, ["text"]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = library(r.row.text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(r.row.text or ""))
    assert bpe.token_digests(empty).count() == 0


def test_decode_gives_the_text_back(odd):
    coded = bpe.encode(odd).select("row.*", "ids")
    for r in bpe.decode(coded).collect():
        assert r.decoded == (r.text or "")
    assert bpe.decode(coded.withColumn("ids", F.lit(None).cast("array<int>"))).where("decoded is not null").count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=200), st.integers(1, 40))
def test_coder_round_trip(ids, block):
    array = np.array(ids, np.int64)
    assert id_coder.unpack(id_coder.pack(array, 16, block)).tolist() == ids


def test_coder_learns_and_notices_damage():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 50000, 100), 200)
    data = id_coder.pack(ids, 16)
    assert (id_coder.unpack(data) == ids).all() and len(data) < 0.5 * len(ids) * 2
    for n in (1, 20):
        ids = rng.integers(0, 1 << n, 5000)
        assert (id_coder.unpack(id_coder.pack(ids, n)) == ids).all()
    broken = bytearray(data)
    broken[-40] ^= 0xFF
    with pytest.raises(ValueError):
        id_coder.unpack(bytes(broken))
    with pytest.raises(ValueError):
        id_coder.unpack(data[:-2])


def test_token_files(spark, odd, empty, tmp_path):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids_file.write_ids(docs, f"{tmp_path}/a", segment=500)
    got = {r.doc_id: r for r in ids_file.read_ids(spark, f"{tmp_path}/a").collect()}
    sums = {r.doc_id: r for r in ids_file.read_checksums(spark, f"{tmp_path}/a").collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        want = library(r.text) + [0]
        assert (got[r.doc_id].start, got[r.doc_id].ids) == (start, want)
        assert (sums[r.doc_id].start, sums[r.doc_id].n_tokens) == (start, len(want))
        assert sums[r.doc_id].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    ids_file.write_ids(odd, f"{tmp_path}/b")
    assert ids_file.read_checksums(spark, f"{tmp_path}/b").count() == odd.count()
    ids_file.write_ids(empty, f"{tmp_path}/c")
    assert ids_file.read_checksums(spark, f"{tmp_path}/c").count() == 0


ITEMS = [("1", "The long dark night with a red hat and then it ran off"), ("2", "sat on"), ("10", "sat ON"), ("3", ""), ("4", None),
         (None, "é \U0001d11e"), ("5", "two"), ("1", "cat sat on a mat and then it ran off into")]


def plain_hits(text, items):
    words = PLAIN_WORDS.findall(lowered(text or ""))
    hit, found = set(), set()
    for name, item in items:
        want = PLAIN_WORDS.findall(lowered(item or ""))
        n = min(10, len(want))
        for k in range(len(want) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == want[k : k + n]:
                    found.add(name or "")
                    hit |= set(range(i, i + n))
    return len(words), hit, found


@pytest.mark.parametrize("limit", [decontaminate.SLICE_BYTES, 40])
def test_decontamination(spark, odd, empty, limit):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    rows = decontaminate.hits(odd, benchmark, ["text"], limit=limit).collect()
    assert len(rows) == odd.count()
    for r in rows:
        n, hit, found = plain_hits(r.row.text, ITEMS)
        assert r.n_words == n and sorted(r["items"]) == list(r["items"]) == sorted(found)
        assert {i for s in r.spans for i in range(s.start, s.end)} == hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert decontaminate.hits(empty, benchmark).count() == 0
    assert decontaminate.hits(odd, benchmark.where("false")).where(F.size("spans") > 0).count() == 0
    clean = decontaminate.drop_contaminated(odd, benchmark)
    assert clean.columns == odd.columns and 0 < clean.count() < odd.count()


def plain_kept(docs, width):
    seen, out = set(), {}
    for i, text in sorted(docs):
        words = SPACED_WORDS.findall(text or "")
        gone = set()
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                gone |= set(range(k, k + width))
            seen.add(window)
        out[i] = len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)
    return out


@pytest.mark.parametrize("width,cells", [(20, repeats.MAX_CELLS), (3, repeats.MAX_CELLS), (1, 1 << 10), (5, 1 << 10)])
def test_repeats(spark, odd, empty, width, cells):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = plain_kept([(r.doc_id, r.text) for r in docs.collect()], width)
    rows = repeats.remove_repeats(docs, width=width, max_cells=cells).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == want
    assert repeats.remove_repeats(odd, width=width).count() == odd.count()
    assert repeats.remove_repeats(empty, width=width).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(5)
    texts = pa.array([" ".join(map(str, rng.integers(0, 3, 40))) for _ in range(30)])
    windows = repeats.Windows(texts, 6)
    places = np.unique(windows.anchor)
    value, n = np.unique(windows.hash, return_counts=True)
    again = np.isin(windows.hash, value[n > 1])
    anchor, m = np.unique(windows.anchor_hash[places], return_counts=True)
    assert np.isin(windows.anchor_hash[windows.anchor[again]], anchor[m > 1]).all()


def test_queries_match_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in queries.QUERIES["op7_benchmark_decontamination"](spark, sf).collect():
        n, hit, found = plain_hits(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    kept = plain_kept(list(docs.items()), 20)
    for r in queries.QUERIES["op9_substring_dedup"](spark, sf).collect():
        n, gone, text = kept[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, sha(text))
    ids = {i: library(t) for i, t in docs.items()}
    for r in queries.QUERIES["op6_bpe_encode_decode"](spark, sf).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), sha(",".join(map(str, ids[r.doc_id]))), sha(docs[r.doc_id]))
    start = 0
    for r in sorted(queries.QUERIES["op1_token_id_files"](spark, sf).collect()):
        want = np.array(ids[r.doc_id] + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_coder_beats_a_table_of_frequencies():
    """Phrases that come again: below the entropy of order 0."""
    rng = np.random.default_rng(4)
    phrases = rng.integers(0, 40_000, (300, 6))
    ids = phrases[rng.zipf(1.3, 50_000) % 300].ravel()
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    data = id_coder.pack(ids, 16)
    assert (id_coder.unpack(data) == ids).all()
    assert 8 * len(data) / len(ids) < 0.8 * -(share * np.log2(share)).sum()
    head = id_coder._HEAD.itemsize
    broken = bytearray(data)
    broken[head + 5] ^= 0xFF
    with pytest.raises(ValueError):
        id_coder.unpack(bytes(broken))


def test_repeats_under_text_ids_and_a_hot_phrase(spark):
    """Ids of any type; a phrase of 12 words in all documents with other words around it."""
    rng = np.random.default_rng(8)
    word = lambda n: ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]
    phrase, passage = word(12), word(25)
    rows = []
    for i in range(120):
        words = word(30) + phrase + word(30) + (passage if i % 10 == 0 else [])
        rows.append((f"d{(i * 37) % 120}", " ".join(words)))
    docs = spark.createDataFrame(rows + [(None, " ".join(passage))], "doc_id string, text string").repartition(5)
    got = {r.row.doc_id: (r.n_words, r.n_removed) for r in repeats.remove_repeats(docs).collect()}
    # the row without an id comes first and keeps the passage
    assert got == {d: (len(t.split()), 25 if " ".join(passage) in t and d is not None else 0) for d, t in rows} | {None: (25, 0)}
    dates = docs.where("doc_id is not null").selectExpr("date_add(date'2020-01-01', cast(substring(doc_id, 2) as int)) as doc_id", "text")
    kept = [r.row.doc_id for r in repeats.remove_repeats(dates).collect() if r.n_removed == 0 and r.n_words == 97]
    assert len(kept) == 1 and str(kept[0]) == "2020-01-01"
    double = repeats.remove_repeats(docs.withColumn("doc_id", F.lit("same")))
    assert double.count() == 121


JOINED = ["red.Hat", "don't", "it's.", "x's'", "a<|endoftext|>.b", "a<|endoftext|", "end|oftext", "end.\n\nNext", "end\nNext", "end.\n next",
          "\nA", "a\n", "\u00e9.\u00d7.\u00f7!", "e\u0301.", "\u00a0.\n\u00a0A", "9.5,x", "a\r\nB", "a \n B", "\u1680\nC", "\U0001d11e.\nD", "\u00aa.", "_a_b", "\t\nE", ""]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(JOINED + [" ", "  ", "\n", ".", "w", "\u00df"]), max_size=12).map("".join), min_size=1, max_size=6))
def test_finer_pieces_are_encoded_like_whole_texts(texts):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = ids_file.Encoder(f.read()) if not KEPT else KEPT[0]
    KEPT[:] = [encoder]
    ids, at = encoder.encode(pa.array(texts), 0)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library(t) + [0] for t in texts]


KEPT: list = []


def test_words_before_signs_reach_the_library_once():
    """Signs and line breaks behind a word do not make it a new piece."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    text = " ".join(w + tail for tail in (".", ",", "!", "###", "\nThen", "") for w in words)
    encoder = ids_file.Encoder(spec)
    ids, _ = encoder.encode(pa.array([text]), 0)
    assert ids.tolist() == library(text) + [0]
    assert len(encoder.known) < 2 * len(words)
    # signs of an added token and tokenizers that are not plainly byte-level are left alone
    assert not ids_file.signs(["<|endoftext|>"])[[ord("<"), ord("|"), ord(">")]].any()
    assert ids_file.Encoder(spec.replace('"add_prefix_space": false', '"add_prefix_space": true').replace('"add_prefix_space":false', '"add_prefix_space":true')).finer is None


def test_coder_rounds_of_equal_size():
    rng = np.random.default_rng(6)
    ids = rng.zipf(1.4, 3 * id_coder.LANES + 5) % 60_000
    for block in (1, 2):
        assert (id_coder.unpack(id_coder.pack(ids, 16, block)) == ids).all()
    n = 2 * id_coder.LANES + 1
    assert 3 * id_coder._together(n) - n < 3 and id_coder._together(1) == 1
    # rare ids of few bits each side by side with certain ones
    ids = np.where(rng.random(300_000) < 0.001, rng.integers(0, 1 << 16, 300_000), 7)
    data = id_coder.pack(ids, 16)
    assert (id_coder.unpack(data) == ids).all() and 8 * len(data) < 2 * len(ids)
