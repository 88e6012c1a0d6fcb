"""Column functions against plain Python."""

import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.functions import binding, masking, score, spans, text
from spanloom.operators import evaluate, vocab


def plain_norm(s):
    """Scans words and gaps; an article becomes a gap."""
    bare = s.lower().translate(dict.fromkeys(map(ord, string.punctuation)))
    parts = re.findall(r"\w+|\W+", bare)
    return " ".join("".join(" " if p in {"a", "an", "the"} else p for p in parts).split())


def plain_f1(p, g):
    """Twice the shared words over all words."""
    p, g = plain_norm(p).split(), plain_norm(g).split()
    left, shared = list(g), 0
    for word in p:
        if word in left:
            left.remove(word)
            shared += 1
    return 2 * shared / (len(p) + len(g)) if shared else 0.0


TEXTS = [
    "", "the", "The  cat, a dog!", "thé an'd the’s", "a the b", "the the the x", "\tThe\n",
    "𝄞 an 𝄞", "_the_ the-end", "no.punct(uation) $5 `x` ~y", "été ANTHEM an", "x\x1cy\x85z",
]


def test_normalize(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", text.normalize_answer("t").alias("n"), text.answer_tokens("t").alias("w")).collect()
    assert {r.t: r.n for r in got} == {t: plain_norm(t) for t in TEXTS}
    assert {r.t: r.w for r in got} == {t: plain_norm(t).split() for t in TEXTS}


def test_scores(spark):
    r = random.Random(5)
    pairs = [(p, g) for p in TEXTS for g in TEXTS]
    pairs += [(" ".join(r.choices("u v w the x", k=9)), " ".join(r.choices("u v v w", k=7))) for _ in range(30)]
    df = spark.createDataFrame([(i, *pg) for i, pg in enumerate(pairs)], "i long, p string, g string")
    got = df.select("i", score.token_f1("p", "g").alias("f"), score.exact_match("p", "g").alias("e")).collect()
    long = {x.i: x for x in evaluate.token_f1_long(df, "i", "p", "g").collect()}
    assert len(got) == len(long) == len(pairs)
    for x in got:
        p, g = pairs[x.i]
        assert x.f == long[x.i].f1 == pytest.approx(plain_f1(p, g))
        assert 0 <= x.f <= 1 and x.e == (plain_norm(p) == plain_norm(g))
        assert not x.e or x.f == 1 or plain_norm(p) == ""


def test_best_over_golds(spark):
    rows = [(0, "The cat", ["dog", "a cat", "cat sat"]), (1, "", ["", "x"]), (2, "x", []), (3, "b b c", ["b c d", "b b"])]
    df = spark.createDataFrame(rows, "i long, pred string, golds array<string>")
    short = {r.i: (r.em, r.f1) for r in evaluate.score_answers(df).collect()}
    assert short[0] == (1, 1.0) and short[1] == (1, 0.0) and short[2] == (None, None)
    assert short[3] == (0, pytest.approx(max(plain_f1("b b c", g) for g in ["b c d", "b b"])))
    total = evaluate.squad_eval(evaluate.score_answers(df)).first()
    assert (total.n, total.n_unscored) == (3, 1) and total.exact_match == pytest.approx(200 / 3)
    assert evaluate.squad_eval(evaluate.score_answers(df.limit(0))).first().f1 is None


def test_alignment(spark):
    cases = [
        ("hello world", "world", 6, (6, 11)), ("hello world", "world", 7, (6, 11)),
        ("hello world", "world", 8, (6, 11)), ("hello world", "world", 9, None),
        ("hello world", "d", 0, None), ("abc", "a", 1, (0, 1)), ("abc", "a", 2, (0, 1)),
        ("x𝄞y", "y", 2, (2, 3)), ("abc", "", 2, (2, 2)), ("abcabc", "abc", 3, (3, 6)), ("ld", "l", 0, (0, 1)),
        ("a", "a", 30, None),
    ]
    df = spark.createDataFrame([(i, c, g, s) for i, (c, g, s, _) in enumerate(cases)], "i int, c string, g string, s int")
    for r in df.select("i", spans.align_answer("c", "g", "s").alias("x")).collect():
        assert (tuple(r.x) if r.x else None) == cases[r.i][3]
    mixed = spark.createDataFrame([("Hello World", "world", 7), ("hello World", "World", 6)], "c string, g string, s int")
    got = [r.x for r in mixed.select(spans.align_answer_ci("c", "g", "s").alias("x")).collect()]
    assert tuple(got[0]) == (6, 11) and got[1] is None


def cut(q, c, room):
    q, c = list(q), list(c)
    while len(q) + len(c) > room:
        (q if len(q) > len(c) else c).pop()
    return q, c


def test_encode_pair(spark):
    sizes = [(a, b) for a in range(0, 9) for b in range(0, 9)]
    df = spark.createDataFrame(
        [(i, [f"q{j}" for j in range(a)], [f"c{j}" for j in range(b)]) for i, (a, b) in enumerate(sizes)],
        "i int, q array<string>, c array<string>",
    )
    for length in (4, 7, 10, 11, 30):
        got = df.select("q", "c", spans.encode_pair(F.col("q"), F.col("c"), length).alias("e")).collect()
        for r in got:
            q, c = cut(r.q, r.c, length - 4)
            body = ["<s>", *q, "</s>", "</s>", *c, "</s>"]
            assert r.e.input == body + ["<pad>"] * (length - len(body))
            assert r.e.attention_mask == [1] * len(body) + [0] * (length - len(body))
            assert len(r.e.token_type_ids) == length
    with pytest.raises(ValueError):
        spans.encode_pair(F.col("q"), F.col("c"), 3)


def test_positions(spark):
    context = "Él 𝄞𝄞 went\n home"
    df = spark.createDataFrame([(i,) for i in range(-1, len(context) + 2)], "at int").withColumn("c", F.lit(context))
    got = {r.at: r.t for r in df.select("at", text.char_to_token("c", "at").alias("t")).collect()}
    for at, token in got.items():
        inside = 0 <= at < len(context) and not context[at].isspace()
        assert token == (len(context[: at + 1].split()) - 1 if inside else None)
    spans_of = [(s, e) for s in range(0, len(context) + 1) for e in range(s, len(context) + 1)]
    pairs = spark.createDataFrame(spans_of, "s int, e int").withColumn("c", F.lit(context))
    for r in pairs.select("s", "e", text.span_tokens("c", "s", "e").alias("x")).collect():
        assert (r.x.start, r.x.end) == (got[r.s], got[r.e - 1]), (r.s, r.e)
    toks = df.limit(1).select(text.tokenize_offsets("c").alias("t")).first().t
    assert [x.tok for x in toks] == context.split()
    assert all(context[x.start : x.end] == x.tok for x in toks)
    words = df.limit(1).select(text.tokenize_offsets("c", r"[\p{L}\p{N}]+").alias("t")).first().t
    assert [x.tok for x in words] == ["Él", "went", "home"]
    rows = text.token_rows(df.limit(2), "c", "at").collect()
    assert len(rows) == 8 and {r.pos for r in rows} == {0, 1, 2, 3}


def test_policies(spark):
    rows = [(5, 9), (None, 9), (5, None), (500, 512), (500, 513), (None, 513), (None, None)]
    df = spark.createDataFrame(rows, "s long, e long")
    want = {
        "null": [(5, 9), (None, None), (None, None), (500, 512), (500, 513), (None, None), (None, None)],
        "null_zero": [(5, 9), (None, None), (None, None), (500, 512), (0, 0), (None, None), (None, None)],
        "zero": [(5, 9), (None, 9), (5, None), (500, 512), (0, 0), (0, 0), (None, None)],
        "fill_max": [(5, 9), (512, 9), (5, 512), (500, 512), (500, 513), (512, 513), (512, 512)],
    }
    for policy, pairs in want.items():
        got = df.select(spans.span_policy(F.col("s"), F.col("e"), policy, 512).alias("p")).collect()
        assert [tuple(r.p) for r in got] == pairs
    with pytest.raises(ValueError):
        spans.span_policy(F.col("s"), F.col("e"), "other", 512)


def test_extract(spark):
    rows = [(["a", "b", "c"], [0.0, 2.0, 2.0], [0.0, 1.0, 3.0]), (["a", "b", "c"], [0.0, 0.0, 1.0], [5.0, 5.0, 1.0])]
    df = spark.createDataFrame(rows, "t array<string>, s array<float>, e array<float>")
    got = df.select(spans.extract_span("t", "s", "e").alias("x"), spans.argmax("e").alias("m")).collect()
    assert [(r.x, r.m) for r in got] == [("b c", 2), ("", 0)]


def test_matches(spark):
    rows = [("x", ["x"], None, True), ("x", None, "x", True), ("x", ["y", None], None, False), (None, ["x"], "x", False), ("X", ["x"], "x", False)]
    df = spark.createDataFrame(rows, "o string, t array<string>, n string, want boolean")
    assert all(r.got == r.want for r in df.select("want", score.alias_match("o", "t", "n").alias("got")).collect())
    said = spark.createDataFrame([(' "a" b',), ("",), ("x",)], "o string").select(score.clean_output("o").alias("c"))
    assert [r.c for r in said.collect()] == ["a b", "", ""]


def test_binary_metrics(spark):
    df = spark.createDataFrame([([0.1, 0.9], 1), ([0.9, 0.1], 1), ([0.5, 0.5], 0), ([0.0, 1.0], 0)], "logits array<double>, label int")
    m = evaluate.binary_metrics(df).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 1, 1, 1) and m.accuracy == m.precision == m.recall == m.f1 == 0.5
    none = evaluate.binary_metrics(df.where("label = 0").limit(1)).first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0, 0, 0, 1)


def test_bits(spark):
    df = spark.createDataFrame([(0.5, 1), (1.5, 3)], "loss double, n int")
    assert evaluate.bits_per_token(df).first().loss == 1.0
    assert evaluate.bits_per_token(df, weight="n").first().loss == 1.25


def test_mask(spark):
    ids = [0, *range(5, 3005), 2]
    df = spark.createDataFrame([(b, ids) for b in range(8)] + [(8, [])], "b long, ids array<bigint>")

    def run(frame, seed):
        m = masking.mlm_mask(F.col("ids"), F.col("b"), seed, 5000, 4, [0, 2])
        return {r.b: (r.m.input_ids, r.m.labels) for r in frame.select("b", m.alias("m")).collect()}

    one, two = run(df, 7), run(df.repartition(5), 7)
    assert one == two != run(df, 8)
    chosen = masked = 0
    for b, (new, labels) in one.items():
        if b == 8:
            assert (new, labels) == ([], [])
            continue
        assert labels[0] == labels[-1] == -100 and (new[0], new[-1]) == (0, 2)
        for old, n, label in zip(ids, new, labels):
            assert label in (-100, old) and (label != -100 or n == old)
            chosen += label != -100
            masked += label != -100 and n == 4
    assert 0.13 < chosen / 24000 < 0.17 and 0.75 < masked / chosen < 0.85


def test_vocabulary(spark, monkeypatch):
    r = random.Random(3)
    docs = [(i, r.choices(["the", "b", "c", "d", "é", "<unk>"], [50, 5, 5, 3, 1, 1], k=r.randint(0, 12))) for i in range(40)]
    docs.append((99, None))
    df = spark.createDataFrame(docs, "k long, w array<string>")
    counts = Counter(t for _, w in docs for t in w or [] if t != "<unk>")
    top = sorted(counts, key=lambda t: (-counts[t], t))
    for size in (1, 3, 4, 50):
        v = vocab.build_vocab(df, F.col("w"), size).collect()
        assert {x.token: x.token_id for x in v if x.token_id > 4} == {t: i + 5 for i, t in enumerate(top[:size])}
    v = vocab.build_vocab(df, F.col("w"), 3).cache()
    known = {t: i + 5 for i, t in enumerate(top[:3])}
    want = {k: None if w is None else [known.get(t, 3) for t in w] for k, w in docs}
    names = {i: t for t, i in known.items()}

    def both():
        ids = vocab.tokens_to_ids(df, "w", v, key="k")
        back = vocab.ids_to_tokens(ids, "ids", v, key="k").collect()
        assert {x.k: x.ids for x in back} == want
        assert {x.k: x.tokens for x in back} == {
            k: None if i is None else [names.get(x, "<unk>") for x in i] for k, i in want.items()
        }
        flat = vocab.vocab_lookup(df.select("k", F.posexplode("w").alias("p", "token")), v, ["k", "p"])
        assert flat.where("token_id = 3").count() == sum(i.count(3) for i in want.values() if i)

    both()
    monkeypatch.setattr(vocab, "broadcast_if_small", lambda frame, *_: (frame, False))
    both()


@pytest.mark.parametrize("segment", [5, 100, 10**6])
def test_frequent_tokens_are_counted_without_the_tail(spark, monkeypatch, segment):
    monkeypatch.setattr(vocab, "SEGMENT_TOKENS", segment)
    r = random.Random(segment)
    words = [f"w{int(r.paretovariate(0.9)) % 3000}" for _ in range(30_000)] + [f"once{i}" for i in range(3000)]
    r.shuffle(words)
    rows = [(words[i : i + 30] + [None, "<s>"],) for i in range(0, len(words), 30)] + [(None,), ([],)]
    df = spark.createDataFrame(rows, "w array<string>").repartition(4)
    exact = Counter(words)
    for size in (1, 20, 100, 10**6):
        counts = {x.token: x.n for x in vocab.frequent_counts(df, F.col("w"), size).collect()}
        assert all(exact[t] == n for t, n in counts.items()) and "<s>" not in counts
        least = sorted(exact.values(), reverse=True)[min(size, len(exact)) - 1]
        assert {t for t, n in exact.items() if n >= least} <= set(counts)
        if size <= 20 and segment > 5:
            assert len(counts) < 0.2 * len(exact), "rare tokens are pruned"


def test_whole_vocabulary(spark):
    rows = [(["b", "a", "b", "<unk>", "é"],), (["a", "b", "zz"],), (None,)]
    v = vocab.build_vocab(spark.createDataFrame(rows, "w array<string>"), F.col("w")).collect()
    assert {x.token: x.token_id for x in v if x.token_id > 4} == {"b": 5, "a": 6, "zz": 7, "é": 8}


def test_once_and_let(spark):
    df = binding.once(spark.range(3), a=F.rand(1)).where("a >= 0").withColumn("same", F.col("a") == F.col("a"))
    assert all(r.same for r in df.collect())
    assert [r.x for r in spark.range(2).select(binding.let(F.col("id") + 1, lambda v: v * v).alias("x")).collect()] == [1, 4]


def test_offsets_after_missing_texts(spark):
    texts = [None, "x    yy zzz", "", None, " a b ", "   ", "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    for r in df.select("t", text.tokenize_offsets("t").alias("o")).collect():
        want = None if r.t is None else [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", r.t)]
        assert (None if r.o is None else [tuple(x) for x in r.o]) == want


def test_own_tokenizer(spark):
    """Pairs of letters as tokens, by a batch function."""
    def pairs(batch):
        return [None if t is None else [(t[i : i + 2], i, min(i + 2, len(t))) for i in range(0, len(t), 2)] for t in batch]

    from spanloom.plans import qa_features

    df = spark.createDataFrame([(1, "qq", "abcdefgh", (["de"], [3])), (2, None, "ab", (["zz"], [0]))],
                               "seq long, question string, context string, answers struct<text:array<string>,answer_start:array<int>>")
    got = {r.seq: r for r in qa_features.label_spans(df.where("seq = 1"), 32, tokenize=text.batch_tokenizer(pairs)).collect()}
    assert got[1].encoded.input[:9] == ["<s>", "qq", "</s>", "</s>", "ab", "cd", "ef", "gh", "</s>"]
    assert (got[1].start_positions, got[1].end_positions) == (5, 6)
    first = qa_features.label_spans(df.where("seq = 1"), 32, tokenize=text.batch_tokenizer(pairs), context_first=True).first()
    assert (first.start_positions, first.end_positions) == (2, 3)


def test_key_table():
    import random

    import numpy as np
    import pyarrow as pa

    from spanloom.functions import batches

    draw = random.Random(2)
    words = sorted({"".join(draw.choice("aé中b") for _ in range(draw.randrange(9))) for _ in range(400)} | {"x" * 5000, "x" * 4999})
    table = batches.KeyTable(pa.array(words), pa.array(range(len(words)), pa.int64()))
    asked = [*words, None, "not there", "x" * 5001] + words[::-1]
    want = [{w: i for i, w in enumerate(words)}.get(w) for w in asked]
    assert table.find(pa.array(asked)).to_pylist() == want and table.find(pa.array(asked).slice(7, 9)).to_pylist() == want[7:16]
    numbers = batches.KeyTable(pa.array([5, -3, 9], pa.int64()), pa.array(["a", "b", "c"]))
    assert numbers.find(pa.array([9, None, 4, 5, -3, 10])).to_pylist() == ["c", None, None, "a", "b", None]
    for kind in (pa.string(), pa.int64()):
        nothing = batches.KeyTable(pa.array([], kind), pa.array([], pa.int64()))
        assert nothing.find(pa.array([None, None], kind)).to_pylist() == [None, None]
    # keys that share a hash
    clash = batches.KeyTable(pa.array(words), pa.array(range(len(words)), pa.int64()))
    clash._marks = lambda keys: np.array([len(k) % 3 for k in keys.to_pylist()], np.uint64)
    order = np.argsort(clash._marks(pa.array(words)), kind="stable")
    clash.marks, clash.keys, clash.values = clash._marks(pa.array(words))[order], pa.array(words).take(order), pa.array(order)
    clash.run = len(words)
    assert clash.find(pa.array(asked)).to_pylist() == want


def test_exchange_by_distinct_tokens(spark, monkeypatch):
    from spanloom.operators import vocab

    rows = [(i, None if i % 9 == 0 else [f"w{(i * k) % 13}" if (i + k) % 11 else None for k in range(i % 7)], "x") for i in range(200)]
    df = spark.createDataFrame(rows, "ids long, words array<string>, tokens string").repartition(3)
    table = spark.createDataFrame([(f"w{k}", 100 + k, 1) for k in range(10)], "token string, token_id long, n long")
    want = sorted((i, None if w is None else [100 + int(x[1:]) if x and int(x[1:]) < 10 else 3 for x in w]) for i, w, _ in rows)
    unknown = vocab.SPECIAL_TOKENS.index(vocab.UNK)
    want = [(i, None if w is None else [unknown if x == 3 else x for x in w]) for i, w in want]
    for bound, size in ((10**6, 10), (0, 10), (0, 1), (0, 10**6)):
        monkeypatch.setattr(vocab, "CHUNK_TOKENS", size)
        found = vocab.tokens_to_ids(df, "words", table, out="found", max_rows=bound)
        assert found.columns == ["ids", "words", "tokens", "found"]
        assert sorted((r.ids, r.found) for r in found.collect()) == want
        back = vocab.ids_to_tokens(found, "found", table, out="tokens", max_rows=bound)
        assert sorted((r.ids, r.tokens) for r in back.collect()) == [
            (i, None if w is None else [f"w{x - 100}" if x != unknown else vocab.UNK for x in w]) for i, w in want
        ]
    plan = vocab.tokens_to_ids(df, "words", table, max_rows=0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode(words") == 1 and "posexplode(tokens" not in plan
    assert vocab.tokens_to_ids(df.where("false"), "words", table, max_rows=0).collect() == []


def test_answers_cut_out_of_the_context(spark):
    pieces = [("can", 0, 3), ("not", 3, 6), (",", 6, 7), ("say", 9, 12)]
    rows = [
        ("cannot,  say", pieces, [0.0, 2.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0], "not,  say"),
        ("cannot,  say", pieces, [3.0, 2.0, 1.0, 0.0], [0.0, 1.0, 1.0, 0.0], "cannot"),
        ("cannot,  say", pieces, [0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0], ""),
        ("cannot,  say", pieces, [0.0, 0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0, 0.0, 1.0], ""),
        ("", [], [1.0], [1.0], ""),
        (None, pieces, [1.0], [1.0], None),
        ("cannot", pieces, None, [1.0], None),
    ]
    schema = "context string, pieces array<struct<tok:string,start:long,end:long>>, s array<double>, e array<double>, want string"
    df = spark.createDataFrame(rows, schema)
    got = df.select("want", spans.extract_span_text("context", "pieces", "s", "e").alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_flat_tokenizer(spark):
    import numpy as np
    import pyarrow as pa

    def letters(texts):
        rows = texts.to_pylist()
        first = np.cumsum([0, *map(len, rows)])
        flat = "".join(rows)
        start = np.concatenate([np.arange(len(r)) for r in rows] or [np.zeros(0, int)])
        return pa.array(list(flat), pa.string()), start, start + 1, first

    rows = [(i, t) for i, t in enumerate(["ab", None, "", "é中", None])]
    df = spark.createDataFrame(rows, "i long, t string").coalesce(1)
    got = {r.i: r.x for r in df.select("i", text.flat_tokenizer(letters)(F.col("t")).alias("x")).collect()}
    assert got[1] is None and got[4] is None and got[2] == []
    assert [tuple(x) for x in got[0]] == [("a", 0, 1), ("b", 1, 2)] and [tuple(x) for x in got[3]] == [("é", 0, 1), ("中", 1, 2)]
    assert df.where("t is null").select(text.flat_tokenizer(letters)(F.col("t")).alias("x")).first().x is None


def test_only_tokens_beyond_the_head_are_joined(spark, monkeypatch):
    """Ids below the bound are looked up where the rows are; the vocabulary's other rows are not copied."""
    from spanloom.operators import vocab

    rows = [(i, [None if (i + k) % 7 == 6 else f"w{(i * k) % 13}" for k in range(i % 9)]) for i in range(150)] + [(-1, None)]
    df = spark.createDataFrame(rows, "k long, w array<string>").repartition(3)
    table = spark.createDataFrame([(f"w{k}", k, 1) for k in range(11)], "token string, token_id long, n long")
    number = lambda x: int(x[1:]) if x and int(x[1:]) < 11 else 3
    want = {k: w and [number(x) for x in w] for k, w in rows}
    for bound, size in ((0, 10**6), (1, 10), (5, 3), (5, 10**6), (10, 10)):
        monkeypatch.setattr(vocab, "CHUNK_TOKENS", size)
        ids = vocab.tokens_to_ids(df, "w", table, out="w", max_rows=bound)
        assert ids.columns == ["k", "w"] and {r.k: r.w for r in ids.collect()} == want
        back = vocab.ids_to_tokens(ids, "w", table, out="t", max_rows=bound)
        assert {r.k: r.t for r in back.collect()} == {k: w and [f"w{x}" for x in w] for k, w in want.items()}
        flat = df.select("k", F.posexplode("w").alias("pos", "token"))
        found = vocab.vocab_lookup(flat, table, ["k", "pos"], max_rows=bound, salts=4)
        assert found.columns == ["k", "pos", "token", "token_id"]
        assert {(r.k, r.pos): r.token_id for r in found.collect()} == {(k, p): x for k, w in want.items() for p, x in enumerate(w or [])}
    # the shuffled vocabulary stays one row a token where no token is frequent
    monkeypatch.setattr(vocab, "FREQUENT", 1)
    seen = []
    join = type(df).join
    monkeypatch.setattr(type(df), "join", lambda a, b, *x: (seen.append(b) if "_salt" in b.columns else None, join(a, b, *x))[1])
    vocab.vocab_lookup(flat, table, ["k", "pos"], max_rows=0)
    assert [b.count() for b in seen] == [11]


def test_batches_are_bounded_by_bytes(spark):
    import pandas as pd

    from spanloom.functions.text import flat_tokenizer, tokenize_offsets
    from spanloom.operators import hooks, vocab
    from spanloom.session import BATCH, BATCH_BYTES

    df = spark.range(0, 600, 1, 1).select("id", F.expr("repeat('word ', 20000)").alias("text"))
    for use in (
        lambda: hooks.map_rows(df, lambda p: pd.DataFrame({"n": [len(p)]}), "n long"),
        lambda: tokenize_offsets("text"),
        lambda: flat_tokenizer(lambda texts: None),
        lambda: vocab.frequent_counts(df, F.split("text", " "), 3),
    ):
        spark.conf.unset(BATCH)
        use()
        assert spark.conf.get(BATCH) == str(BATCH_BYTES)
    # 60 MB of text in one partition
    rows = hooks.map_rows(df, lambda p: pd.DataFrame({"n": [len(p)]}), "n long").collect()
    assert sum(r.n for r in rows) == 600 and max(r.n for r in rows) * 100_000 < 2 * BATCH_BYTES
    # a bound that the user set stays
    spark.conf.set(BATCH, "12345678")
    tokenize_offsets("text")
    assert spark.conf.get(BATCH) == "12345678"
    spark.conf.unset(BATCH)
