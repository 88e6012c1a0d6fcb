"""Cuts texts into pieces that a byte-level tokenizer never joins, and counts each piece once.

A text may be cut before a space between two characters that are not white space:
no pre-token reaches over it. Finer cuts, where asked for, part a word from the signs
behind it and a line break from its neighbours, so that there are fewer distinct pieces.
Distinct pieces are tokenised once per chunk, and the ids of whole texts are gathered
from them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from spanloom.llm.words import strings, text_buffer

# the lead bytes of two-byte characters that are never white space
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True


_ALPHA = np.zeros(256, bool)
_ALPHA[0x41:0x5B] = _ALPHA[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SPACE, _BREAK = 0x20, 0x0A


def signs(added: list[str]) -> np.ndarray:
    """The bytes of finer cuts: ASCII signs and the line break, without those in added tokens."""
    table = _GRAPH & ~_ALPHA & ~_DIGIT
    table[_BREAK] = True
    table[list("".join(added).encode())] = False
    return table


class Pieces:
    """``distinct`` pieces, the ``codes`` of all pieces in text order, ``first`` piece of each text."""

    def __init__(self, texts: pa.Array, finer: np.ndarray | None = None):
        data, offsets = text_buffer(texts)
        at = np.flatnonzero(data == _SPACE)
        at = at[(at > 1) & (at < len(data) - 1)]
        cut = (_GRAPH[data[at - 1]] | (_LEAD[data[at - 2]] & (data[at - 1] >= 0x80))) & (
            _GRAPH[data[at + 1]] | _LEAD[data[at + 1]]
        )
        runs = [offsets, at[cut]]
        if finer is not None:
            runs += _finer(data, finer)
        # runs in order, which a stable sort merges
        bounds = np.concatenate(runs)
        bounds.sort(kind="stable")
        kept = np.ones(len(bounds), bool)
        np.not_equal(bounds[1:], bounds[:-1], out=kept[1:])
        bounds = bounds[kept]
        coded = strings(data, bounds).dictionary_encode()
        self.distinct = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.searchsorted(bounds, offsets)

    def gather(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text begins, from those of the distinct pieces."""
        many = lengths[self.codes]
        begin = (np.cumsum(lengths) - lengths)[self.codes]
        ends = np.concatenate([[0], np.cumsum(many)])
        flat = np.repeat(begin - ends[:-1], many) + np.arange(ends[-1])
        return ids[flat], ends[self.first]


def _finer(data: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """Cuts between a letter and a sign, before a line break behind a visible character, and
    behind such a break if a letter follows: no pre-token reaches over them either."""
    at = np.flatnonzero(table[data])
    at = at[(at > 1) & (at < len(data) - 1)]
    before = data[at - 1]
    # A-Z, a-z and the letters of Latin-1, whose code has no sign but two
    letter = _ALPHA[before] | ((data[at - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
    line = (data[at] == _BREAK) & _GRAPH[before]
    alone = at[line & _ALPHA[data[at + 1]]] + 1
    return [at[line | (letter & (data[at] != _BREAK))], alone]
