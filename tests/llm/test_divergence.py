"""Term shares of sources against plain Python; the SQL runs in test_sql."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import divergence
from spanloom.llm.words import Words

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [t.decode() for t in TERM.findall(lower)]


def brute(rows, least, top):
    """Rows of (text, lang, source)."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms(text))
        df[lang].update(set(terms(text)))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        q = share(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", over, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])}
    return out


def got(docs, **more):
    return [tuple(r) for r in divergence.audit(docs, **more).collect()]


def test_odd_rows(spark, odd, empty):
    want = brute([(r.text, r.lang, None) for r in odd.collect()], 2, 3)
    rows = got(odd, source="fp", min_documents=2, top=3)  # one source: no pairs
    assert {(a, "", *r) for a, _, *r in rows} == want and all(r[1] == "s" for r in rows)
    assert got(empty, source="fp") == []
    assert got(odd, source="n_words", min_documents=10**6) and {r[4] for r in got(odd, source="n_words", min_documents=10**6)} == {0}


def test_sources_against_brute_force(spark):
    draw = np.random.default_rng(7)
    vocabulary = [w * k for w in ("ab", "Zürich", "é", "longword", "exactly8", "wordbeyond", "中文") for k in (1, 2, 12)]
    rows = []
    for i in range(400):
        words = draw.choice(vocabulary, size=draw.integers(0, 12)).tolist()
        rows.append((i, " ".join(words) if i % 17 else None, [None, "en", "de", "xx"][i % 4] if i != 399 else "only", [None, "a", "b", "Ä", "hot", "hot"][draw.integers(0, 6)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    for least in (1, 8, 25):
        rows_out = got(docs, min_documents=least, top=4)
        assert len(rows_out) == len(set(rows_out)) and set(rows_out) == brute([r[1:] for r in rows], least, 4)


def test_small_units_give_the_same(spark, monkeypatch):
    """Merging, tiles of sources and slices of a text at sizes that these rows exceed."""
    rows = [(f"w{i % 7}x w{i % 11}y common " * (1 + i % 3), "en", f"s{i % 9}") for i in range(150)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(2).cache()
    want = brute(rows, 5, 50)
    kept = [t.as_py() for t in divergence.term_runs(pa.array(["a bb a ccc bb a"]), np.zeros(1, np.int32), 2)["term"]]
    assert sorted(kept) == ["a", "bb", "ccc"]
    tables = [divergence.term_runs(pa.array(["a bb a ccc bb a " * 9]), np.zeros(1, np.int32), size) for size in (3, 10**6)]
    assert [sorted((r["term"], r["n"], r["df"]) for r in t.to_pylist()) for t in tables] == [[("a", 27, 1), ("bb", 18, 1), ("ccc", 9, 1)]] * 2
    tiny = "from spanloom.llm import divergence as d\nd.GATHER, d.TILE, d.CELLS = 10, 4, 16"
    monkeypatch.setattr(divergence, "TILE", 4)

    def small(fn):
        def run(batches):
            exec(tiny, {})
            yield from fn(batches)

        return run

    monkeypatch.setattr(divergence, "_count", small(divergence._count))
    monkeypatch.setattr(divergence, "_differences", small(divergence._differences))
    assert set(got(docs, min_documents=5)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abB é\x00", max_size=40) | st.integers(1, 200).map(lambda n: "ab" * n), max_size=8), st.integers(1, 5))
def test_pointer_sort(texts, groups):
    texts = pa.array([t.replace("\x00", "-") for t in texts], pa.string())
    words = Words(texts, divergence.LETTERS, lower=True)
    data = np.concatenate([words.data, np.zeros(8, np.uint8)])
    order, new = divergence.sort_pointers(data, words.starts, words.ends)
    plain = [data[s:e].tobytes() for s, e in zip(words.starts, words.ends, strict=True)]
    assert order.tolist() == sorted(range(len(plain)), key=lambda i: (plain[i], i))
    assert new.tolist() == [i == 0 or plain[order[i]] != plain[order[i - 1]] for i in range(len(order))]
    group = np.arange(len(texts), dtype=np.int32) % groups
    want, docs = Counter(), Counter()
    for i, t in enumerate(texts.to_pylist()):
        want.update((i % groups, w) for w in terms(t))
        docs.update({(i % groups, w) for w in terms(t)})
    table = divergence.term_runs(texts, group).to_pylist()
    assert {(r["g"], r["term"]): (r["n"], r["df"]) for r in table} == {k: (n, docs[k]) for k, n in want.items()} and len(table) == len(want)
