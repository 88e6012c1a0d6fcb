"""Token ids of whole documents in binary containers (method: context-mixing range coder).

Documents are tokenised with the tokenizers library, ended by an id, ordered by id
of document and written as containers (see ``id_coder``) of about ``SEGMENT`` ids,
one row of a Parquet file each, with the documents' ids and token counts beside it.
A document never spans two containers. Where a document starts follows from sums
per partition and within each partition, not from one pass over all rows.

Defined cases: a null or empty text is the end id alone; null document ids come
first; rows with equal ids are ordered by a hash of their text; an empty table
writes files without rows; other columns are never looked at.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import id_coder
from spanloom.llm.bpe import default_path
from spanloom.llm.pieces import Pieces, signs
from spanloom.llm.words import text_chunks

#: Ids aimed at in one container.
SEGMENT = 1 << 22
#: Distinct pieces that a Python worker remembers, at most.
KNOWN = 2_000_000
END = 0
#: Pieces that the tokenizer takes in one call, each as a word by itself.
TOGETHER = 2_000


def _finer(spec: dict) -> np.ndarray | None:
    """The finer cuts a tokenizer allows, which are those of plain byte-level pre-tokens."""
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    cutter, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    if spec.get("normalizer") or any(cutter.get(k) != v for k, v in plain.items()):
        return None
    if any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word")):
        return None
    return signs([t["content"] for t in added])


def _bytes(vocab: dict[str, int], added: list[dict]) -> np.ndarray | None:
    """A byte-level token has a letter for each byte, an added one is text."""
    if "" in vocab:
        return None
    out = np.zeros(1 + max(vocab.values()), np.int64)
    out[list(vocab.values())] = [len(t) for t in vocab]
    for t in added:
        out[t["id"]] = len(t["content"].encode())
    return out


class Encoder:
    """The tokenizers library on distinct pieces of texts."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        read = json.loads(spec)
        self.finer = _finer(read)
        # how many bytes each id stands for, where that tells pieces apart
        self.bytes = None if self.finer is None else _bytes(self.tokenizer.get_vocab(), read.get("added_tokens") or [])
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    @classmethod
    def of(cls, shared: dict) -> "Encoder":
        """The encoder of this Python worker; later tasks go on with the pieces it knows."""
        if "encoder" not in shared:
            shared["encoder"] = cls(shared["spec"])
        return shared["encoder"]

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one behind the other, and how many each has."""
        if len(self.known) > KNOWN:
            self._forget()
        at = pc.index_in(pieces, self.known)
        fresh = at.is_null().to_numpy(zero_copy_only=False)
        new = pieces.filter(pa.array(fresh))
        ids, lengths = self._fresh(new)
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[fresh] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        many = self.lengths[at]
        begin = (np.cumsum(self.lengths) - self.lengths)[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        return self.ids[np.repeat(begin - ends[:-1], many) + np.arange(ends[-1])], many

    def _fresh(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = np.asarray(new).tolist()
        if self.bytes is not None and words:
            # ids have the bytes of what they stand for, which tells where each piece ends
            runs = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
            found = self.tokenizer.encode_batch_fast(runs, is_pretokenized=True, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
            reached = np.cumsum(self.bytes[ids])
            wanted = np.cumsum(pc.binary_length(new).to_numpy())
            ends = np.searchsorted(reached, wanted) + 1
            if ends[-1] == len(ids) and (reached[ends - 1] == wanted).all():
                return ids, np.diff(ends, prepend=0)
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        lists = [e.ids for e in found]
        lengths = np.array([len(x) for x in lists], np.int64)
        return np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum())), lengths

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each text begins."""
        pieces = Pieces(texts, self.finer)
        ids, at = pieces.gather(*self.distinct(pieces.distinct))
        return np.insert(ids, at[1:], end), at + np.arange(len(at))


_SCHEMA = "part int, seq long, n_ids long, docs array<struct<doc_id:{kind},n:long>>, data binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", end: int = END, segment: int = SEGMENT) -> None:
    """Write the containers of all documents below ``path``, in ascending order of the id."""
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast({"spec": f.read()})
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = Encoder.of(spec.value)
        bits = max(1, int(encoder.tokenizer.get_vocab_size() - 1).bit_length())
        held, names, counts, size = [], [], [], 0

        def flush():
            n = pa.array(np.concatenate(counts))
            docs = pa.StructArray.from_arrays([pa.concat_arrays(names), n], ["doc_id", "n"])
            columns = [
                pa.array([part], pa.int32()),
                pa.array([seq], pa.int64()),
                pa.array([size], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                pa.array([id_coder.pack(np.concatenate(held), bits)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_ids", "docs", "data"])

        for batch, texts in text_chunks(batches):
            ids, at = encoder.encode(texts, end)
            held.append(ids)
            names.append(batch.column("doc_id"))
            counts.append(np.diff(at))
            size += len(ids)
            if size >= segment:
                yield flush()
                seq += 1
                held, names, counts, size = [], [], [], 0
        if counts:
            yield flush()

    ordered.mapInArrow(run, _SCHEMA.format(kind=kind)).write.parquet(path)


def _starts(files: DataFrame) -> DataFrame:
    """``part``, ``seq`` and ``first``: the ids before each container."""
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per partition of the writer
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return sizes.withColumn("inside", inside).join(before, "part").select(
        "part", "seq", (F.col("before") + F.col("inside")).alias("first")
    )


def _decoded(files: DataFrame, name: str, kind: str, each) -> DataFrame:
    """``part``, ``seq``, ``doc_id``, ``inside``, ``n_tokens`` and ``name`` made from the ids of each document."""
    id_kind = files.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                docs = batch.column("docs").slice(k, 1).flatten()
                n = docs.field("n").to_numpy()
                at = np.concatenate([[0], np.cumsum(n)])
                ids = id_coder.unpack(batch.column("data")[k].as_buffer()).astype("<u4")
                if at[-1] != len(ids):
                    raise ValueError("a container does not hold the ids of its documents")
                columns = [batch.column(c).take(pa.array(np.full(len(n), k))) for c in ("part", "seq")]
                columns += [docs.field("doc_id"), pa.array(at[:-1]), pa.array(n), each(ids, at)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "inside", "n_tokens", name])

    schema = f"part int, seq long, doc_id {id_kind}, inside long, n_tokens long, {name} {kind}"
    return files.select("part", "seq", "docs", "data").mapInArrow(run, schema)


def _placed(files: DataFrame, decoded: DataFrame, name: str) -> DataFrame:
    return decoded.join(_starts(files), ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", name
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` from the files; damage raises an error."""
    files = spark.read.parquet(path)

    def lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))

    return _placed(files, _decoded(files, "ids", "array<int>", lists), "ids")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of the ids read from the files."""
    files = spark.read.parquet(path)

    def sums(ids: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.array([id_coder.checksum(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())

    return _placed(files, _decoded(files, "ids_crc32", "long", sums), "ids_crc32")
