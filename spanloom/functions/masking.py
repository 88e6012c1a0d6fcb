"""Seeded draws: masking for masked language models, shuffle keys.

Every draw is a function of seed and position, so a retried task draws the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.batches import map_lists

# Share of chosen tokens; of these 80 % become the mask, 10 % a
# random token and 10 % stay; the label of tokens that were not chosen.
SHARE = 0.15
MASKED = 0.8
REPLACED = 0.9
IGNORED = -100

# Constants of the 32-bit integer mixing behind the draws.
MULTIPLIER = 73244475
STRIDE = 2654435761
SEED_STRIDE = 1000003
WORD = 2**32


def seeded_key(seed: int, *parts: Column) -> Column:
    """A reproducible pseudo-random bigint (60 bits)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix32(x: np.ndarray) -> np.ndarray:
    """Scrambles 32-bit numbers held as uint64."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(16))) * np.uint64(MULTIPLIER) % np.uint64(WORD)
    return x ^ (x >> np.uint64(16))


def mlm_mask(
    ids: Column,
    block: Column,
    seed: int,
    vocab_size: int,
    mask_id: int,
    special_ids: list[int],
    share: float = SHARE,
) -> Column:
    """``struct<input_ids, labels>`` with about ``share`` of the tokens chosen.

    Special tokens are never chosen. A label is the old id of a chosen token and
    -100 elsewhere.
    """
    word = np.uint64(WORD)
    stride = np.uint64(STRIDE)
    chosen_below = np.uint64(int(share * WORD))
    masked_below, replaced_below = np.uint64(int(MASKED * WORD)), np.uint64(int(REPLACED * WORD))

    def mask(token: np.ndarray, pos: np.ndarray, row: np.ndarray) -> dict[str, np.ndarray]:
        start = mix32((row.astype(np.uint64) + np.uint64(seed * SEED_STRIDE)) % word)
        first = mix32(start ^ (pos.astype(np.uint64) * stride % word))
        second = mix32((first + stride) % word)
        chosen = (first < chosen_below) & ~np.isin(token, special_ids)
        other = (mix32(second) % np.uint64(vocab_size)).astype(np.int64)
        changed = np.where(
            second < masked_below, mask_id, np.where(second < replaced_below, other, token)
        )
        return {
            "input_ids": np.where(chosen, changed, token),
            "labels": np.where(chosen, token, IGNORED),
        }

    return map_lists(mask, ["input_ids", "labels"])(ids.cast("array<bigint>"), block.cast("bigint"))
