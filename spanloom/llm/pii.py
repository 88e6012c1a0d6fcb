"""Personal data in texts (method: linear-chain CRF over word-shape features).

Exact patterns find the base spans. A conditional random field, trained on a small
labelled table and decoded by Viterbi in numpy batches, reads the runs of words
around digits and at-signs in every text and adds spans that the patterns miss,
for example two card numbers that one greedy match runs together. An added span
must hold to the rules of its kind and must not touch a base span.

Defined cases: a null or empty text has no spans; repeated rows have equal spans;
texts of any length are read whole; other columns are never looked at. Positions
are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm import crf
from spanloom.llm.words import SPACED, Words, code_points, measure

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a later start inside one run of digits can only fail as the first one did
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

#: Labelled text: personal data stands in brackets behind its kind.
LABELLED = """
write to [email:anna.fox@mail.example.org] or call [phone:+1 (555) 010-4477] before noon
[email:b_21@post.example.com] wrote from [ip:10.20.30.40] on 12 May 2019
his number is [phone:+1 (201) 555-0100] [ip:203.0.113.77] and the host
reached at [phone:+44 20 7946 0958] or by mail
two cards [card:4000000000000002] [card:5555555555554444] were charged
the card [card:4111 1111 1111 1111] expired in 2021
pay with [card:4242-4242-4242-4242] or [card:378282246310005] today
[card:6011111111111117] [phone:+1 (312) 555-0199] the rest
address [ip:192.0.2.1] port 8080 and [ip:198.51.100.23] port 443
from [ip:172.16.254.1] [ip:172.16.254.3] to the end
[phone:+1 (404) 555-0142] [phone:+1 (404) 555-0143] both
[ip:8.8.8.8] [phone:+1 (717) 555-0175] [email:x.y@host.example.net]
[phone:+49 30 901820] is an office line
licensed under version 2.0. of the text
attribution 4.0. international and version 1.2.3 of the tool
in 1999 there were 1200 people and 35 houses
section 3.1.4 of chapter 12 on page 345
token "dafbac99949115180e7593de87b4492b" was revoked
key = 40d78a45c4183ab8ca1b325bc44516 is not personal
item 12345678 costs 19.99 and 7 more cost 3.50
the ratio 0.5 to 1.5 at 20:15 on 2020-01-31
rows 1 2 3 4 5 6 7 8 9 10 11 12
order 123456 of 2018-05-06 number 77
+5 degrees and -12 at night
call 112 or 911 in an emergency
a list: 1. first 2. second 3. third
@home and @work are not mail addresses
build 1.2.3.4.5 and 300.400.500.600 are no hosts
chapter 10 [email:c-d@sub.example.co.uk] chapter 11
"""

_MARK = re.compile(r"\[(email|ip|card|phone):([^\]]*)\]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_CORE = re.compile(r"[+(@A-Za-z0-9](?:.*[@A-Za-z0-9)])?", re.S)
#: Label 0 is outside; then begin and inside of each kind.
N_LABELS = 1 + 2 * len(KINDS)


def labelled_table(spark) -> DataFrame:
    """The labelled lines as ``text`` and ``spans`` (kind, start, end)."""
    rows = []
    for line in LABELLED.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in _MARK.finditer(line):
            text += line[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        rows.append((text + line[at:], spans))
    return spark.createDataFrame(
        rows, "text string, spans array<struct<kind:string,start:long,end:long>>"
    )


def core(token: str) -> tuple[int, int]:
    """The part of a token without leading and trailing marks."""
    m = _CORE.search(token)
    return m.span() if m else (0, 0)


def shape(token: str) -> str:
    """Letters as a, digits as counted runs, other characters as they are; long shapes are cut to a class."""
    a, b = core(token)
    out = re.sub(r"[^\W\d_]+", "a", token[a:b])
    out = _DIGITS.sub(lambda m: f"d{min(len(m[0]), 20)}", out)
    return out if len(out) <= 24 else "long"


def coarse(token: str) -> str:
    """The shape without lengths."""
    return re.sub(r"(a|d\d+)[ad0-9.\-]*", "w", shape(token)) + ("#" if re.search("[0-9]", token) else "")


class Tagger:
    """Feature numbers and the trained field."""

    def __init__(self, numbers: dict, model: dict):
        self.numbers, self.model = numbers, model

    def features(self, tokens: list[str], first: np.ndarray) -> np.ndarray:
        """Own, previous and next shape and own coarse shape; 0 where unseen."""
        get = self.numbers.get
        own = np.array([get(("s", shape(t)), 0) for t in tokens], np.int64)
        rough = np.array([get(("c", coarse(t)), 0) for t in tokens], np.int64)
        last, following = np.zeros_like(own), np.zeros_like(own)
        shapes = [shape(t) for t in tokens]
        last[1:] = [get(("p", s), 0) for s in shapes[:-1]]
        following[:-1] = [get(("n", s), 0) for s in shapes[1:]]
        last[first] = get("start", 0)
        following[np.append(first[1:], len(tokens)) - 1] = get("end", 0)
        return np.stack([own, rough, last, following], axis=1)

    def tag(self, tokens: list[str], lengths: np.ndarray) -> np.ndarray:
        """Best label of each token."""
        first = np.cumsum(lengths) - lengths
        field = crf.Model.load(self.model)
        score = field.emissions(self.features(tokens, first))
        out = np.zeros(len(tokens), np.int64)
        for group in crf.batches(lengths):
            at, there = crf.padded(first[group], lengths[group])
            best = crf.viterbi(score[at], there, field.transition, field.start)
            out[at[there]] = best[there]
        return out


def train(labelled: DataFrame) -> Tagger:
    """Fit the field on a small labelled table (``text``, ``spans``), which is read on the driver."""
    tokens, labels, lengths = [], [], []
    for row in labelled.collect():
        n = len(tokens)
        spans = sorted((s["start"], s["end"], s["kind"]) for s in row["spans"] or [])
        for m in _TOKEN.finditer(row["text"] or ""):
            a, b = core(m[0])
            a, b = m.start() + a, m.start() + b
            label = 0
            for start, end, kind in spans:
                if a < end and b > start:
                    label = 1 + 2 * KINDS.index(kind) + (a > start)
            tokens.append(m[0])
            labels.append(label)
        lengths.append(len(tokens) - n)
    numbers: dict = {None: 0, "start": 1, "end": 2}
    for t in tokens:
        for key in (("s", shape(t)), ("c", coarse(t)), ("p", shape(t)), ("n", shape(t))):
            numbers.setdefault(key, len(numbers))
    size = np.array([n for n in lengths if n], np.int64)
    tagger = Tagger(numbers, {})
    features = tagger.features(tokens, np.cumsum(size) - size)
    field = crf.Model(len(numbers), N_LABELS).fit(features, np.array(labels), size, rounds=120)
    tagger.model = field.__dict__
    return tagger


def luhn(digits: str) -> bool:
    """Check digit of a card number."""
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def valid(kind: str, found: str) -> bool:
    """The rules that a match of a kind must hold to."""
    if kind == "ip":
        parts = [p.lstrip("0") for p in found.split(".")]
        return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    digits = "".join(_DIGITS.findall(found))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the exact patterns, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m[0])]
    return sorted(out)


_FULL = {
    "ip": re.compile(r"[0-9]+(\.[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+?[(0-9][\x20().0-9-]+[0-9]"),
}


def _fits(kind: str, found: str) -> bool:
    if kind == "email":
        return [(0, len(found))] == emails(found)
    return bool(_FULL[kind].fullmatch(found)) and valid(kind, found)


def _windows(near: np.ndarray, owner: np.ndarray, reach: int = 2) -> np.ndarray:
    """Words at most ``reach`` words from a marked word of the same text."""
    out = near.copy()
    for k in range(1, reach + 1):
        same = owner[k:] == owner[:-k]
        out[:-k] |= near[k:] & same
        out[k:] |= near[:-k] & same
    return out


def find(texts: pa.Array, tagger: Tagger) -> tuple[list, list]:
    """Base spans and all spans of each text, as sorted (start, kind number, end)."""
    words = Words(texts, SPACED)
    data, owner = words.data, words.owner
    mark = ((data >= 0x30) & (data <= 0x39)) | (data == 0x40)
    marks = np.concatenate([[0], np.cumsum(mark)])
    near = marks[words.ends] > marks[words.starts]
    base: list[list] = [[] for _ in range(len(texts))]
    spans: list[list] = [[] for _ in range(len(texts))]
    kept = np.flatnonzero(_windows(near, owner))
    if not len(kept):
        return base, spans
    known = {}
    for i in np.unique(owner[kept]).tolist():
        known[i] = texts[i].as_py()
        base[i] = base_spans(known[i])
        spans[i] = list(base[i])
    # a sequence is a run of neighbouring kept words of one text
    first = np.flatnonzero(
        np.concatenate([[True], (np.diff(kept) > 1) | (owner[kept][1:] != owner[kept][:-1])])
    )
    lengths = np.diff(np.append(first, len(kept)))
    points = np.concatenate([[0], np.cumsum(code_points(data))])
    begin = points[words.starts[kept]] - points[words.offsets[owner[kept]]]
    end = points[words.ends[kept]] - points[words.offsets[owner[kept]]]
    of = owner[kept].tolist()
    tokens = [known[i][a:b] for i, a, b in zip(of, begin.tolist(), end.tolist())]
    labels = tagger.tag(tokens, lengths)
    leads = set(first.tolist())
    at, n = 0, len(tokens)
    for at in np.flatnonzero(labels).tolist():
        kind, inside = divmod(int(labels[at]) - 1, 2)
        if inside and at not in leads and labels[at - 1] in (2 * kind + 1, 2 * kind + 2):
            continue  # within a span that began before
        last = at
        while last + 1 < n and last + 1 not in leads and labels[last + 1] == 2 * kind + 2:
            last += 1
        i = of[at]
        start = int(begin[at]) + core(tokens[at])[0]
        stop = int(begin[last]) + core(tokens[last])[1]
        clear = all(b <= start or a >= stop for a, _, b in base[i])
        if clear and _fits(KINDS[kind], known[i][start:stop]):
            spans[i].append((start, kind, stop))
    return base, [sorted(x) for x in spans]


def written(spans: list) -> str:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)


def _shared(docs: DataFrame, labelled: DataFrame | None):
    spark = docs.sparkSession
    tagger = train(labelled_table(spark) if labelled is None else labelled)
    return spark.sparkContext.broadcast((tagger.numbers, tagger.model))


def detect(docs: DataFrame, keep: list[str] | None = None, labelled: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``row``, ``n_email`` … ``n_phone`` and ``base_sha256`` of the base spans, ``spans`` of all."""
    shared = _shared(docs, labelled)
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def run(texts: pa.Array) -> list:
        base, spans = find(texts, Tagger(*shared.value))
        counts = [[sum(s[1] == k for s in x) for x in base] for k in range(len(KINDS))]
        digest = [hashlib.sha256(written(x).encode()).hexdigest() for x in base]
        return [*[pa.array(c, pa.int64()) for c in counts], digest, [written(x) for x in spans]]

    return measure(docs, run, fields, keep, text)


def masked(text: str, spans: list) -> str:
    """The text with every span, or union of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The rows with personal data replaced in the text; a column ``n_chars`` follows it."""
    shared = _shared(docs, labelled)

    def run(texts: pa.Array) -> list:
        spans = find(texts, Tagger(*shared.value))[1]
        at = [i for i, x in enumerate(spans) if x]
        out = np.empty(len(texts), dtype=object)
        out[:] = None
        for i in at:
            out[i] = masked(texts[i].as_py(), spans[i])
        return [pa.array(out.tolist(), pa.string())]

    found = measure(docs, run, [T.StructField("masked", T.StringType())], None, text)
    new = F.coalesce("masked", F.col(f"row.`{text}`"))
    columns = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == text:
            value = new
        elif c == "n_chars":
            value = F.when(F.col("masked").isNull(), value).otherwise(F.length(new)).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return found.select(*columns)
