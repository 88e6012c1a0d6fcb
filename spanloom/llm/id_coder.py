"""Adaptive context-mixing range coder for blocks of token ids.

A block starts from nothing and carries a checksum, so it can be read alone with its
container's head. Many blocks are coded in step, one lane each, as numpy rows.

For each id there are three predictions: the id last seen behind the two ids before
it (order 2), behind the one before it (order 1), and the frequencies of all ids of the
container (order 0), which its head holds. What is coded is whether the first or the second
is right (class 0, 1), else (class 2) the id by its frequency. Class frequencies are
mixed from two adaptive models, one by the confidence of the two context
predictions and one by the last two classes; each lane shifts weight to the model
that came nearer. All arithmetic is on integers, so every machine decodes alike.

Most ids are of class 2, so a step codes all lanes as such and then mends the others.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
LANES = 2048
SLOTS2, SLOTS1 = 256, 256
#: Frequencies of the ids of a container add up to two to this power; every id that occurs has one.
FREQUENCY = 18
#: Class frequencies add up to this power of two; the models' to half of it.
SCALE = 12
_HALF = 1 << (SCALE - 1)
_RATE = 5
_LOW, _WORD = np.uint64(1 << 32), np.uint64(32)
_REST = _LOW - np.uint64(1)
_SCALE, _FREQUENCY, _WHOLE = np.uint64(SCALE), np.uint64(FREQUENCY), np.uint64(1 << SCALE)
#: Upper edges of the classes 0 and 1 once a class is certain, packed into 32 bits.
_CERTAIN = np.array([[_HALF, _HALF], [0, _HALF], [0, 0]], np.int16).view(np.int32).ravel()
# where a block begins: an eighth for each context
_EVEN = np.array([_HALF // 8, _HALF // 4], np.int16).view(np.int32)[0]
#: Keeps every class possible.
_FLOOR = np.array([1, 2], np.int16)
#: Steps between two changes of the models' weights.
_PACE = 8
_HASH, _HASH2 = 40503, 30011


def _at(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return table.take(places, mode="clip")  # never out of bounds; spares numpy its check


class _Lanes:
    """The adaptive state of lanes that run in step.

    A prediction and its confidence (0 to 3) share a number. A model is the upper
    edges of the classes 0 and 1, as 16-bit numbers side by side in one of 32 bits.
    """

    def __init__(self, n: int):
        self.last1, self.last2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        tables = np.full(n * (SLOTS2 + SLOTS1), -4, np.int32)
        self.by2, self.by1 = tables[: n * SLOTS2], tables[n * SLOTS2 :]
        # places are 64-bit numbers, as numpy looks up by those
        lane = np.arange(n)
        self.base2, self.base1, self.base_model = lane * SLOTS2, lane * SLOTS1, lane * 16
        self.recent = np.zeros(n, np.int64)
        self.by_sure, self.by_past = np.full(n * 16, _EVEN), np.full(n * 16, _EVEN)
        # both edges of a lane have its weight
        self.weight, self.floor = np.full(2 * n, 8, np.int16), np.tile(_FLOOR, n)

    def predict(self, m: int) -> None:
        """Predictions, and the upper edges of the classes 0 and 1, of the first ``m`` lanes."""
        mixed = self.last1[:m] * _HASH
        self.at1 = mixed >> 9
        self.at1 &= SLOTS1 - 1
        self.at1 += self.base1[:m]
        mixed += self.last2[:m] * _HASH2
        mixed >>= 9
        mixed &= SLOTS2 - 1
        mixed += self.base2[:m]
        self.at2 = mixed
        self.entry2, self.entry1 = _at(self.by2, self.at2), _at(self.by1, self.at1)
        self.guess2, self.guess1 = self.entry2 >> 2, self.entry1 >> 2
        sure = self.entry2 & 3
        sure <<= 2
        sure |= self.entry1 & 3
        self.sure_at, self.past_at = self.base_model[:m] + sure, self.base_model[:m] + self.recent[:m]
        self.sure = _at(self.by_sure, self.sure_at).view(np.int16)
        self.past = _at(self.by_past, self.past_at).view(np.int16)
        mix = self.past - self.sure
        mix *= self.weight[: 2 * m]
        mix >>= 4
        mix += self.sure
        mix += mix
        mix += self.floor[: 2 * m]
        self.edge0, self.edge1 = mix[0::2], mix[1::2]

    def learn(self, ids: np.ndarray, some: np.ndarray, kinds: np.ndarray, step: int) -> None:
        """Take in the ids; lanes ``some`` have the classes ``kinds``, the others class 2."""
        m = len(ids)
        goal = np.zeros(m, np.int32)
        goal[some] = _CERTAIN[kinds]
        goal = goal.view(np.int16)
        to_sure, to_past = goal - self.sure, goal - self.past
        if step % _PACE == 0:
            # the model whose edges lie nearer to the class that came gains weight
            off = np.abs(to_sure)
            off -= np.abs(to_past)
            gain = np.sign(off[0::2] + off[1::2])
            weight = self.weight[: 2 * m]
            weight[0::2] += gain
            weight[1::2] += gain
            np.minimum(weight, 15, out=weight)
            np.maximum(weight, 1, out=weight)
        for model, at, edges, way in ((self.by_sure, self.sure_at, self.sure, to_sure), (self.by_past, self.past_at, self.past, to_past)):
            way >>= _RATE
            way += edges
            model[at] = way.view(np.int32)
        # a prediction is always the last id; its confidence is how often it has been right
        fresh = ids << 2
        for table, at, entry, right in (
            (self.by2, self.at2, self.entry2, some[kinds == 0]),
            (self.by1, self.at1, self.entry1, some[self.guess1[some] == ids[some]]),
        ):
            table[at] = fresh
            again = entry[right]
            table[at[right]] = np.minimum(again + 1, again | 3)
        self.last2[:m] = self.last1[:m]
        self.last1[:m] = ids
        recent = self.recent[:m]
        recent &= 3
        recent <<= 2
        recent += 2
        recent[some] += kinds - 2


class Frequencies:
    """Order 0: how often each id occurs in a container, scaled to whole numbers of one sum."""

    def __init__(self, shares: np.ndarray):
        self.shares = shares.astype(np.int64)
        #: Where an id begins and, in the lower 32 bits, its share: looked up together.
        self.place = ((np.cumsum(self.shares) - self.shares).astype(np.uint64) << _WORD) | self.shares.astype(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> Frequencies:
        counts = np.bincount(ids, minlength=1 << bits).astype(np.int64)
        total, whole = max(int(counts.sum()), 1), 1 << FREQUENCY
        seen = int((counts > 0).sum())
        if seen > whole:
            raise ValueError(f"more than {whole} distinct ids in a container")
        # each id that occurs has one, the rest is shared out in proportion; what is over goes to the most frequent
        shares = np.where(counts > 0, 1 + counts * (whole - seen) // total, 0)
        shares[int(counts.argmax())] += whole - int(shares.sum())
        return cls(shares)

    def ids(self) -> np.ndarray:
        """The id of each number below the sum."""
        return np.repeat(np.arange(len(self.shares), dtype=np.int32), self.shares)

    def stored(self) -> bytes:
        return zlib.compress(self.shares.astype("<u4").tobytes(), 6)

    @classmethod
    def read(cls, data: bytes, bits: int) -> Frequencies:
        try:
            shares = np.frombuffer(zlib.decompress(data), "<u4")
        except zlib.error as e:
            raise ValueError("the frequencies of a container are damaged") from e
        if len(shares) != 1 << bits or int(shares.sum()) != 1 << FREQUENCY:
            raise ValueError("the frequencies of a container are damaged")
        return cls(shares)


def _running(lengths: np.ndarray, step: int) -> int:
    """How many lanes still run; lanes are sorted by falling length."""
    return len(lengths) if step < lengths[-1] else int(np.searchsorted(-lengths, -step, side="left"))


def _settled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The spans, cut where the leading word is not settled yet so that it is."""
    over = np.flatnonzero((low & _REST) + span >= _LOW)
    span[over] = (~low[over] + np.uint64(1)) & _REST
    return span


def encode_lanes(ids: np.ndarray, lengths: np.ndarray, frequencies: Frequencies) -> list[np.ndarray]:
    """Code words of each lane; ``ids`` is (lane, position), lanes sorted by falling length."""
    n, steps = ids.shape
    state = _Lanes(n)
    columns = np.ascontiguousarray(ids.T, np.int32)
    low, span = np.zeros(n, np.uint64), np.full(n, np.iinfo(np.uint64).max)
    # an id takes at most SCALE + FREQUENCY bits, so one word
    wide = steps + 2
    out, at = np.zeros(n * wide, np.uint32), np.arange(n) * wide
    begin = at.copy()
    for t in range(steps):
        m = _running(lengths, t)
        now = columns[t, :m]
        state.predict(m)
        lo, sp = low[:m], span[:m]
        second = state.guess2 == now
        some = np.flatnonzero(second | (state.guess1 == now))
        kinds = 1 - second[some]
        r = sp >> _SCALE
        # the classes 0 and 1
        edge0, r_some = state.edge0[some].astype(np.uint64), r[some]
        width = np.where(kinds == 0, edge0, state.edge1[some].astype(np.uint64) - edge0)
        edge0[kinds == 0] = 0
        lo_some, sp_some = lo[some] + r_some * edge0, r_some * width
        # class 2
        edge = state.edge1.astype(np.uint64)
        lo += r * edge
        r *= _WHOLE - edge
        r >>= _FREQUENCY
        share = _at(frequencies.place, now.astype(np.int64))
        lo += r * (share >> _WORD)
        share &= _REST
        np.multiply(r, share, out=sp)
        lo[some], sp[some] = lo_some, sp_some
        state.learn(now, some, kinds, t)
        need = np.flatnonzero(sp < _LOW)
        lo_need = lo[need]
        pos = at[need]
        out[pos] = lo_need >> _WORD
        at[need] = pos + 1
        sp[need] = _settled(lo_need, sp[need]) << _WORD
        lo[need] = lo_need << _WORD
    for _ in range(2):
        out[at] = low >> _WORD
        at += 1
        low <<= _WORD
    return [out[a:b] for a, b in zip(begin.tolist(), at.tolist())]


def decode_lanes(words: list[np.ndarray], lengths: np.ndarray, frequencies: Frequencies) -> np.ndarray:
    """The ids (lane, position) of code words; lanes sorted by falling length."""
    n, steps = len(lengths), int(lengths.max(initial=0))
    state = _Lanes(n)
    low, span = np.zeros(n, np.uint64), np.full(n, np.iinfo(np.uint64).max)
    # two words of nothing behind each lane
    sizes = np.array([len(w) + 2 for w in words])
    at = np.cumsum(sizes) - sizes
    source = np.zeros(int(sizes.sum()), np.uint64)
    for a, w in zip(at.tolist(), words):
        source[a : a + len(w)] = w
    code = (source[at] << _WORD) | source[at + 1]
    at += 2
    columns = np.zeros((steps, n), np.int32)
    id_at = frequencies.ids()
    most = np.uint64((1 << FREQUENCY) - 1)
    for t in range(steps):
        m = _running(lengths, t)
        state.predict(m)
        lo, sp, co = low[:m], span[:m], code[:m]
        r = sp >> _SCALE
        ahead = co - lo
        edge = state.edge1.astype(np.uint64)
        begin = r * edge
        some = np.flatnonzero(ahead < begin)
        # the classes 0 and 1
        edge0, r_some = state.edge0[some].astype(np.uint64), r[some]
        first = r_some * edge0
        kinds = (ahead[some] >= first).astype(np.int64)
        width = np.where(kinds == 0, edge0, edge[some] - edge0)
        lo_some, sp_some = lo[some] + first * kinds.view(np.uint64), r_some * width
        now_some = np.where(kinds == 0, state.guess2[some], state.guess1[some])
        # class 2; elsewhere the place means nothing
        r *= _WHOLE - edge
        r >>= _FREQUENCY
        ahead -= begin
        ahead //= r
        now = _at(id_at, np.minimum(ahead, most, out=ahead).view(np.int64))
        now[some] = now_some
        lo += begin
        share = _at(frequencies.place, now.astype(np.int64))
        lo += r * (share >> _WORD)
        share &= _REST
        np.multiply(r, share, out=sp)
        lo[some], sp[some] = lo_some, sp_some
        columns[t, :m] = now
        state.learn(now, some, kinds, t)
        need = np.flatnonzero(sp < _LOW)
        lo_need = lo[need]
        pos = at[need]
        code[need] = (co[need] << _WORD) | source[np.minimum(pos, len(source) - 1)]
        at[need] = pos + 1
        sp[need] = _settled(lo_need, sp[need]) << _WORD
        lo[need] = lo_need << _WORD
    return np.ascontiguousarray(columns.T)


def checksum(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


# Container: magic, version, bits of an id, ids, block size, bytes of the frequencies; the
# frequencies of all ids below 2^bits as 32-bit numbers, compressed by zlib; per block its
# code words and the checksum of its ids; the code words. All numbers little-endian, words of 32 bits.
MAGIC = b"SLID"
VERSION = 3
_HEAD = np.dtype([("magic", "S4"), ("version", "<u2"), ("bits", "<u2"), ("ids", "<u8"), ("block", "<u4"), ("frequencies", "<u4")])


def _together(n: int) -> int:
    """How many of ``n`` blocks run in step, in rounds of equal size."""
    return max(1, -(-n // max(1, -(-n // LANES))))


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """A container of the ids in independently coded blocks."""
    n = -(-len(ids) // block)
    head = np.zeros(1, _HEAD)
    frequencies = Frequencies.of(np.asarray(ids, np.int64), bits)
    stored = frequencies.stored()
    head[0] = (MAGIC, VERSION, bits, len(ids), block, len(stored))
    index = np.zeros((n, 2), "<u4")
    parts: list[np.ndarray] = []
    for start in range(0, n, _together(n)):
        some = ids[start * block : (start + _together(n)) * block]
        lanes = -(-len(some) // block)
        lengths = np.full(lanes, block)
        lengths[-1] = len(some) - (lanes - 1) * block
        grid = np.zeros(lanes * block, np.int32)
        grid[: len(some)] = some
        words = encode_lanes(grid.reshape(lanes, block), lengths, frequencies)
        for k, w in enumerate(words):
            index[start + k] = len(w), checksum(some[k * block : (k + 1) * block])
        parts += words
    payload = np.concatenate(parts).astype("<u4").tobytes() if parts else b""
    return head.tobytes() + stored + index.tobytes() + payload


def unpack(data: bytes) -> np.ndarray:
    """The ids of a container; a damaged block raises ValueError."""
    head = np.frombuffer(data, _HEAD, 1)[0]
    if head["magic"] != MAGIC or head["version"] != VERSION:
        raise ValueError("not a container of token ids")
    at = _HEAD.itemsize + int(head["frequencies"])
    total, block, bits = int(head["ids"]), int(head["block"]), int(head["bits"])
    n = -(-total // block)
    frequencies = Frequencies.read(bytes(memoryview(data)[_HEAD.itemsize : at]), bits)
    index = np.frombuffer(data, "<u4", 2 * n, at).reshape(n, 2)
    payload = np.frombuffer(data, "<u4", offset=at + 8 * n)
    ends = np.concatenate([[0], np.cumsum(index[:, 0], dtype=np.int64)])
    if ends[-1] != len(payload):
        raise ValueError("a container of token ids is cut off")
    out = np.zeros(total, np.int64)
    for start in range(0, n, _together(n)):
        stop = min(n, start + _together(n))
        lengths = np.full(stop - start, block)
        if stop == n:
            lengths[-1] = total - (n - 1) * block
        grid = decode_lanes([payload[ends[k] : ends[k + 1]] for k in range(start, stop)], lengths, frequencies)
        for k in range(start, stop):
            ids = grid[k - start, : lengths[k - start]]
            if checksum(ids) != index[k, 1]:
                raise ValueError(f"block {k} is damaged")
            out[k * block : k * block + len(ids)] = ids
    return out
