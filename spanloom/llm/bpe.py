"""Byte-level BPE (method: segment tree over the ranks of adjacent pairs).

The leaves of a tree hold the ranks of a pre-token's neighbouring pairs; its root
yields the leftmost pair of the lowest rank. A merge changes three leaves, each a
path of logarithmic length, until the root has no pair left. Trees of short
pre-tokens lie side by side in a matrix and are updated together; long ones have a
tree of their own.

Defined cases: a null or empty text has no ids and decodes to the empty text; any
length is encoded whole; repeated rows are encoded alike; other columns are kept or
left out as asked and never looked at. Added tokens in a text become their ids.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.pieces import Pieces
from spanloom.llm.words import measure

# the white space of Unicode
_WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The pre-tokens of byte-level BPE
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
NONE = np.iinfo(np.int64).max
#: Pre-tokens of up to this many bytes share a matrix.
SIDE_BY_SIDE = 64
ROWS = 1 << 15


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Bpe:
    """A vocabulary as arrays: pair keys in order, their ranks and results, bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(c.isspace() for t in self.added for c in t):
            raise ValueError("added tokens with white space are not supported")
        letters = byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        back = {c: b for b, c in enumerate(letters)}
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        raw = [b""] * self.size
        for token, i in vocab.items():
            raw[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.added.items():
            raw[i] = token.encode()
        self.raw = pa.array(raw, pa.large_binary())
        self.decimal = pa.array([f"{i},".encode() for i in range(self.size)], pa.large_binary())
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order
        self._made()

    def _made(self) -> None:
        # one probe into a table twice as sparse as the pairs settles nearly every lookup
        self._bits = 64 - max(4, int(len(self.key) * 8).bit_length())
        slot = self._slot(self.key)
        self._at = np.full(1 << (64 - self._bits), -1, np.int64)
        self._at[slot[::-1]] = np.arange(len(self.key))[::-1]
        taken = self._at[slot] != np.arange(len(self.key))
        self._rest, self._rest_rank = self.key[taken], self.rank[taken]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self._bits)).astype(np.int64)

    @classmethod
    def load(cls, state: dict) -> "Bpe":
        bpe = cls.__new__(cls)
        bpe.__dict__.update(state)
        return bpe

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NONE`` where it does not merge."""
        key = a * self.size + b
        at = self._at[self._slot(key)]
        found = (at >= 0) & (self.key[at] == key)
        out = np.where(found, self.rank[at], NONE)
        if len(self._rest):
            left = np.flatnonzero(~found & (at >= 0))
            where = np.minimum(np.searchsorted(self._rest, key[left]), len(self._rest) - 1)
            hit = self._rest[where] == key[left]
            out[left[hit]] = self._rest_rank[where[hit]]
        return out

    def merge_matrix(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Merge rows of ``n`` ids each, side by side; -1 where an id went into its left neighbour."""
        rows, width = ids.shape
        leaves = 1 << (width - 1).bit_length()
        shift = leaves.bit_length()
        following = np.tile(np.arange(1, width + 1), (rows, 1))
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        tree = np.full((rows, 2 * leaves), NONE, np.int64)
        r, c = np.nonzero(np.arange(width - 1)[None, :] < (n - 1)[:, None])
        rank = self.ranks(ids[r, c], ids[r, c + 1])
        good = rank != NONE
        tree[r[good], leaves + c[good]] = (rank[good] << shift) | c[good]
        level = leaves
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        def put(row, place, value):
            at = leaves + place
            tree[row, at] = value
            while leaves > 1:
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
                if at[0] == 1:
                    return

        def pair(row, left, right, there):
            """Set the leaf of a pair; no pair where ``there`` is false."""
            row, left, right, there = row[there], left[there], right[there], None
            if len(row):
                rank = self.ranks(ids[row, left], ids[row, right])
                put(row, left, np.where(rank == NONE, NONE, (rank << shift) | left))

        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            top = tree[row, 1]
            i = top & ((1 << shift) - 1)
            j = following[row, i]
            ids[row, i] = self.result[top >> shift]
            ids[row, j] = -1
            after = following[row, j]
            following[row, i] = after
            more = after < n[row]
            before[row[more], after[more]] = i[more]
            put(row, j, NONE)
            put(row[~more], i[~more], NONE) if not more.all() else None
            pair(row, i, after, more)
            prior = before[row, i]
            pair(row, prior, i, prior >= 0)
            row = row[tree[row, 1] != NONE]
        return ids

    def merge_one(self, ids: list[int]) -> list[int]:
        """Merge one long sequence with a tree of its own."""
        n = len(ids)
        leaves = 1 << max(1, (n - 1).bit_length())
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        array = np.array(ids, np.int64)
        first = self.ranks(array[:-1], array[1:])
        keys = np.full(2 * leaves, NONE, np.int64)
        keys[leaves : leaves + n - 1] = np.where(first == NONE, NONE, first * leaves + np.arange(n - 1))
        for level in (leaves >> k for k in range(leaves.bit_length() - 1)):
            keys[level // 2 : level] = np.minimum(keys[level : 2 * level : 2], keys[level + 1 : 2 * level : 2])
        tree = keys.tolist()
        rank = dict(zip(self.key.tolist(), self.rank.tolist())) if not hasattr(self, "_dict") else self._dict
        self._dict = rank

        def put(place: int, value: int) -> None:
            at = leaves + place
            tree[at] = value
            while at > 1:
                at >>= 1
                tree[at] = min(tree[2 * at], tree[2 * at + 1])

        def pair(left: int, right: int) -> None:
            found = rank.get(ids[left] * self.size + ids[right]) if right < n else None
            put(left, NONE if found is None else found * leaves + left)

        while tree[1] != NONE:
            found, i = divmod(tree[1], leaves)
            j = following[i]
            ids[i], ids[j] = int(self.result[found]), -1
            after = following[i] = following[j]
            if after < n:
                before[after] = i
            put(j, NONE)
            pair(i, after)
            if before[i] >= 0:
                pair(before[i], i)
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one behind the other, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        out: list = [None] * len(words)
        counts = np.zeros(len(words), np.int64)
        low = 1
        parts = []
        while low <= SIDE_BY_SIDE:
            some = np.flatnonzero((size >= low) & (size < 2 * low))
            for start in range(0, len(some), ROWS):
                at = some[start : start + ROWS]
                width = int(size[at].max())
                flat = np.frombuffer(b"".join([words[k] for k in at.tolist()]), np.uint8)
                ids = np.full((len(at), width), -1, np.int64)
                ids[np.arange(width)[None, :] < size[at][:, None]] = self.byte_id[flat]
                if width > 1:
                    ids = self.merge_matrix(ids, size[at])
                counts[at] = (ids >= 0).sum(axis=1)
                parts.append((at, ids[ids >= 0]))
            low *= 2
        for k in np.flatnonzero(size >= low).tolist():
            ids = self.merge_one(self.byte_id[np.frombuffer(words[k], np.uint8)].tolist())
            counts[k] = len(ids)
            parts.append((np.array([k]), np.array(ids, np.int64)))
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(ends[-1], np.int64)
        for at, ids in parts:
            many = counts[at]
            out[np.repeat(ends[at] - np.cumsum(many) + many, many) + np.arange(len(ids))] = ids
        return out, counts

    def encode_distinct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one behind the other, and how many each has."""
        import regex

        cut = regex.compile(PATTERN).findall
        special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        numbers: dict[str, int] = {}
        word_at, n_words = [], np.zeros(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            before = len(word_at)
            at = 0
            for m in special.finditer(piece) if "<" in piece or not self._angled else ():
                word_at += [numbers.setdefault(w, len(numbers)) for w in cut(piece[at : m.start()])]
                word_at.append(-1 - self.added[m[0]])
                at = m.end()
            word_at += [numbers.setdefault(w, len(numbers)) for w in cut(piece[at:] if at else piece)]
            n_words[k] = len(word_at) - before
        ids, counts = self.merge([w.encode() for w in numbers])
        at = np.array(word_at, np.int64)
        known = at >= 0
        many = np.ones(len(at), np.int64)
        many[known] = counts[at[known]]
        begin = np.zeros(len(at), np.int64)
        begin[known] = (np.cumsum(counts) - counts)[at[known]]
        ends = np.concatenate([[0], np.cumsum(many)])
        source = np.concatenate([ids, [0]])[np.minimum(np.repeat(begin - ends[:-1], many) + np.arange(ends[-1]), len(ids))]
        source[ends[:-1][~known]] = -1 - at[~known]
        word_ends = np.concatenate([[0], np.cumsum(n_words)])
        return source, np.diff(ends[word_ends])

    @property
    def _angled(self) -> bool:
        return all("<" in t for t in self.added)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text begins."""
        pieces = Pieces(texts)
        return pieces.gather(*self.encode_distinct(pieces.distinct.to_pylist()))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """UTF-8 of the decoded text of each run of ids; broken sequences are replaced."""
        out = []
        for raw in cut_bytes(pc.take(self.raw, pa.array(ids)), at):
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = raw.decode(errors="replace").encode()
            out.append(raw)
        return out


def cut_bytes(values: pa.Array, at: np.ndarray) -> list[bytes]:
    """The values between neighbouring positions, joined."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset :]
    data = values.buffers()[2]
    raw = memoryview(data) if data is not None else memoryview(b"")
    ends = offsets[at].tolist() if len(values) else [0] * len(at)
    return [bytes(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _shared(spark: SparkSession, path: str | None):
    """The vocabulary, whose size its file fixes, read on the driver."""
    return spark.sparkContext.broadcast(Bpe(path or default_path()).__dict__)


def token_digests(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, text: str = "text") -> DataFrame:
    """``row``, ``n_tokens`` and digests of the ids and of the text decoded from them."""
    shared = _shared(docs.sparkSession, path)
    names = ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())

    def run(texts: pa.Array) -> list:
        bpe = Bpe.load(shared.value)
        ids, at = bpe.encode(texts)
        listed = cut_bytes(pc.take(bpe.decimal, pa.array(ids)), at)
        digest = hashlib.sha256
        return [
            np.diff(at),
            [digest(x[:-1]).hexdigest() for x in listed],
            [digest(x).hexdigest() for x in bpe.decode(ids, at)],
        ]

    return measure(docs, run, [T.StructField(*x) for x in names], keep, text)


def encode(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, text: str = "text") -> DataFrame:
    """``row`` and ``ids``, the token ids of the whole text."""
    shared = _shared(docs.sparkSession, path)

    def run(texts: pa.Array) -> list:
        ids, at = Bpe.load(shared.value).encode(texts)
        return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))]

    return measure(docs, run, [T.StructField("ids", T.ArrayType(T.IntegerType()))], keep, text)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, into: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in a further column; null ids give null."""
    shared = _shared(rows.sparkSession, path)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{ids}`").alias("ids"))
    schema = T.StructType([packed.schema["row"], T.StructField("text", T.StringType())])

    def run(batches):
        bpe = Bpe.load(shared.value)
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = bpe.decode(flat, np.concatenate([[0], np.cumsum(n)]))
            null = lists.is_null().to_pylist()
            column = pa.array([None if gone else t.decode() for gone, t in zip(null, texts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), column], ["row", "text"])

    return packed.mapInArrow(run, schema).select("row.*", F.col("text").alias(into))
