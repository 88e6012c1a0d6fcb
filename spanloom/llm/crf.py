"""A linear-chain conditional random field on numpy batches.

Sequences of one batch are laid out as a padded matrix (position by sequence), so
each step of the recursions handles all sequences at once. Emission scores come
from sparse features: every token has one row of feature numbers.
"""

from __future__ import annotations

import numpy as np

#: Elements of one padded matrix.
CELLS = 1 << 20


def batches(lengths: np.ndarray, cells: int = CELLS):
    """Groups of sequences of similar length, each with at most ``cells`` padded positions."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    start = 0
    while start < len(order):
        stop = start + 1
        # longest last, so the matrix is as high as its last sequence
        step = max(1, cells // int(lengths[order[start]]))
        stop = min(len(order), start + step)
        while stop > start + 1 and int(lengths[order[stop - 1]]) * (stop - start) > 2 * cells:
            stop = start + max(1, (stop - start) // 2)
        yield order[start:stop]
        start = stop


def padded(first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token positions as (step, sequence), and which of them exist."""
    step = np.arange(int(lengths.max()))[:, None]
    there = step < lengths[None, :]
    return np.where(there, first[None, :] + step, 0), there


def viterbi(emission: np.ndarray, there: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best labels (step, sequence) for ``emission`` (step, sequence, label); ties go to the lower label."""
    steps, n, k = emission.shape
    back = np.zeros((steps, n, k), np.int8)
    score = start + emission[0]
    for t in range(1, steps):
        paths = score[:, :, None] + transition[None]
        best = paths.argmax(axis=1)
        moved = np.take_along_axis(paths, best[:, None, :], axis=1)[:, 0] + emission[t]
        back[t] = np.where(there[t][:, None], best, np.arange(k))
        score = np.where(there[t][:, None], moved, score)
    out = np.zeros((steps, n), np.int64)
    out[-1] = score.argmax(axis=1)
    at = np.arange(n)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t, at, out[t]]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def forward_backward(emission: np.ndarray, there: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = True):
    """Label marginals (step, sequence, label), expected transitions, and log normalisers."""
    steps, n, k = emission.shape
    ahead = np.zeros_like(emission)
    ahead[0] = start + emission[0]
    for t in range(1, steps):
        new = _log_sum(ahead[t - 1][:, :, None] + transition[None], 1) + emission[t]
        ahead[t] = np.where(there[t][:, None], new, ahead[t - 1])
    norm = _log_sum(ahead[-1], 1)
    behind = np.zeros_like(emission)
    expected = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        follow = (behind[t + 1] + emission[t + 1])[:, None, :] + transition[None]
        on = there[t + 1]
        behind[t] = np.where(on[:, None], _log_sum(follow, 2), 0.0)
        if pairs:
            joint = np.exp(ahead[t][:, :, None] + follow - norm[:, None, None])
            expected += joint[on].sum(axis=0)
    marginals = np.exp(ahead + behind - norm[None, :, None]) * there[:, :, None]
    return marginals, expected, norm


def chain_marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray, size: int = 64, rows: int = 1 << 18) -> np.ndarray:
    """Label marginals of every token of sequences of any length, each one whole chain.

    ``first`` is where each sequence begins among the tokens, with one more element. Chains
    are worked through in pieces of ``size`` tokens side by side: what a piece does to a
    message that passes it is a matrix, the messages go from piece to piece, and then every
    piece knows what comes before and behind it. The result is that of one run over the whole.
    """
    k = len(start)
    counts = np.diff(first)
    parts = -(-counts // size)
    head = np.cumsum(parts) - parts
    inside = np.arange(parts.sum()) - np.repeat(head, parts)
    begin = np.repeat(first[:-1], parts) + size * inside
    length = np.minimum(size, np.repeat(first[1:], parts) - begin)
    ahead, behind = np.zeros((len(begin), k)), np.zeros((len(begin), k))
    long = np.flatnonzero(np.repeat(parts, parts) > 1)
    if len(long):
        through = np.zeros((len(begin), k, k))
        for group in batches(length[long], rows // k):
            some = long[group]
            at, there = padded(begin[some], length[some])
            now = np.full((len(some), k, k), -1e30)
            now[:, np.arange(k), np.arange(k)] = 0.0
            for t in range(len(at)):
                step = np.broadcast_to(transition, (len(some), k, k))
                if t == 0:  # a chain begins with the start scores, whatever came before
                    step = np.where((inside[some] == 0)[:, None, None], np.broadcast_to(start, (k, k)), step)
                new = _log_sum(now[:, :, :, None] + step[:, None], 2) + emission[at[t]][:, None, :]
                now = np.where(there[t][:, None, None], new, now)
            through[some] = now
        # the first piece of a chain is entered by one label, so that its start counts once
        entry = np.full(k, -1e30)
        entry[0] = 0.0
        chains = np.flatnonzero(parts > 1)
        for step in range(1, int(parts.max())):
            on = chains[parts[chains] > step]
            at = head[on] + step
            before = np.where((step == 1), entry, ahead[at - 1])
            ahead[at] = _log_sum(before[:, :, None] + through[at - 1], 1)
        for step in range(int(parts.max()) - 1, 0, -1):
            on = chains[parts[chains] > step]
            at = head[on] + step
            behind[at - 1] = _log_sum(through[at] + behind[at][:, None, :], 2)
    out = np.zeros((len(emission), k))
    for group in batches(length, rows // k):
        at, there = padded(begin[group], length[group])
        score = emission[at]
        steps, n, _ = score.shape
        front = np.zeros_like(score)
        entered = _log_sum(ahead[group][:, :, None] + transition[None], 1)
        front[0] = np.where((inside[group] == 0)[:, None], start, entered) + score[0]
        for t in range(1, steps):
            new = _log_sum(front[t - 1][:, :, None] + transition[None], 1) + score[t]
            front[t] = np.where(there[t][:, None], new, front[t - 1])
        back = np.zeros_like(score)
        back[steps - 1] = behind[group]
        for t in range(steps - 2, -1, -1):
            follow = (back[t + 1] + score[t + 1])[:, None, :] + transition[None]
            back[t] = np.where(there[t + 1][:, None], _log_sum(follow, 2), behind[group])
        both = front + back
        marginal = np.exp(both - _log_sum(both, 2)[:, :, None])
        out[at[there]] = marginal[there]
    return out


class Model:
    """Weights of features and label transitions."""

    def __init__(self, features: int, labels: int):
        self.weight = np.zeros((features, labels))
        self.transition = np.zeros((labels, labels))
        self.start = np.zeros(labels)

    @classmethod
    def load(cls, state: dict) -> "Model":
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Scores of tokens given by rows of feature numbers."""
        return self.weight[features].sum(axis=1)

    def fit(self, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 60, rate: float = 0.3, l2: float = 1e-3) -> "Model":
        """Maximise the penalised conditional likelihood by Adagrad over the whole table."""
        first = np.cumsum(lengths) - lengths
        groups = [(*padded(first[g], lengths[g]),) for g in batches(lengths)]
        k = self.weight.shape[1]
        seen = np.zeros_like(self.weight)
        flat = np.repeat(np.arange(len(features)), features.shape[1])
        np.add.at(seen, (features.ravel(), labels[flat]), 1.0)
        inside = np.ones(len(labels), bool)
        inside[first[lengths > 0]] = False
        pair_seen = np.zeros((k, k))
        np.add.at(pair_seen, (labels[:-1][inside[1:]], labels[1:][inside[1:]]), 1.0)
        start_seen = np.bincount(labels[first[lengths > 0]], minlength=k).astype(float)
        n = max(1, len(labels))
        memory = [np.full_like(x, 1e-8) for x in (self.weight, self.transition, self.start)]
        for _ in range(rounds):
            score = self.emissions(features)
            marginal = np.zeros((len(labels), k))
            pairs, starts = np.zeros((k, k)), np.zeros(k)
            for at, there in groups:
                m, p, _ = forward_backward(score[at], there, self.transition, self.start)
                marginal[at[there]] = m[there]
                pairs += p
                starts += m[0].sum(axis=0)
            expected = np.zeros_like(self.weight)
            np.add.at(expected, features.ravel(), marginal[flat])
            steps = (seen - expected, pair_seen - pairs, start_seen - starts)
            for value, step, held in zip((self.weight, self.transition, self.start), steps, memory):
                grad = step / n - l2 * value / n
                held += grad**2
                value += rate * grad / np.sqrt(held)
        return self
