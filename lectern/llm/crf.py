"""Linear-chain conditional random field with sparse binary features, trained and decoded with numpy, many chains at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Chains:
    """Chains of items. ``ids``: the features of all distinct rows, of which row i ends at ``ends[i]``; ``row``: the row of each
    item; ``lengths``: the number of items of each chain."""

    ids: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    lengths: np.ndarray

    def groups(self, cells: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(chains, number of item or -1 of each chain and step), longest chains first, in groups of at most ``cells`` cells or
        one chain, so that one very long chain pads no others."""
        order = np.argsort(-self.lengths, kind="stable")
        first = np.cumsum(self.lengths) - self.lengths
        lo = 0
        while lo < len(order):
            longest = max(1, int(self.lengths[order[lo]]))
            own = order[lo : lo + max(1, cells // longest)]
            at = first[own, None] + np.arange(longest)[None]
            yield own, np.where(np.arange(longest)[None] < self.lengths[own, None], at, -1)
            lo += len(own)


class CRF:
    """Weights: emit (features, labels), move (labels, labels), begin (labels)."""

    def __init__(self, features: int, labels: int):
        self.emit, self.move, self.begin = np.zeros((features, labels)), np.zeros((labels, labels)), np.zeros(labels)

    def scores(self, c: Chains) -> np.ndarray:
        """Sums of the weights of each row's features; every row has at least one."""
        if not len(c.ends):
            return np.zeros((0, self.emit.shape[1]))
        return np.add.reduceat(self.emit[c.ids], np.concatenate([[0], c.ends[:-1]]), axis=0)

    def fit(self, c: Chains, gold: np.ndarray, rounds: int = 60, rate: float = 0.5, l2: float = 0.02) -> CRF:
        """Maximum penalised likelihood: full-batch AdaGrad on forward-backward expectations."""
        labels = len(self.begin)
        one = np.eye(labels)
        owner = np.repeat(np.arange(len(c.ends)), np.diff(c.ends, prepend=0))
        by_row = np.argsort(c.row, kind="stable")
        row_start = np.searchsorted(c.row[by_row], np.arange(len(c.ends)))
        by_id = np.argsort(c.ids, kind="stable")
        used, id_start = np.unique(c.ids[by_id], return_index=True)
        groups = list(c.groups())
        inner = np.ones(len(gold), bool)
        inner[np.cumsum(c.lengths)[:-1]] = False
        inner[0] = False
        heads = np.flatnonzero(~inner)
        moved = np.zeros_like(self.move)
        np.add.at(moved, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1.0)
        sums = [np.full_like(w, 1e-8) for w in (self.emit, self.move, self.begin)]
        for _ in range(rounds):
            s = self.scores(c)
            psi = np.exp(s - s.max(axis=1, keepdims=True))[c.row]
            step, start = np.exp(self.move - self.move.max()), np.exp(self.begin - self.begin.max())
            emit, move = np.zeros((len(gold), labels)), np.zeros_like(self.move)
            for _, at in groups:
                self._expect(at, psi, step, start, emit, move)
            rest = one[gold] - emit
            rows = np.add.reduceat(rest[by_row], row_start, axis=0)
            d_emit = np.zeros_like(self.emit)
            d_emit[used] = np.add.reduceat(rows[owner[by_id]], id_start, axis=0)
            for w, d, g2 in zip((self.emit, self.move, self.begin), (d_emit, moved - move, rest[heads].sum(0)), sums, strict=True):
                d = d - l2 * w
                g2 += d * d
                w += rate * d / np.sqrt(g2)
        return self

    @staticmethod
    def _expect(at: np.ndarray, psi: np.ndarray, step: np.ndarray, start: np.ndarray, emit: np.ndarray, move: np.ndarray) -> None:
        """Adds the expected labels and moves of a group of chains (longest first); each step's sums are scaled to 1."""
        steps = at.shape[1]
        size = (at >= 0).sum(0).tolist()
        alpha = [start * psi[at[:, 0]]]
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for t in range(1, steps):
            k = size[t]
            x = (alpha[t - 1][:k] @ step) * psi[at[:k, t]]
            alpha.append(x / x.sum(1, keepdims=True))
        beta = np.ones((0, len(start)))
        for t in range(steps - 1, -1, -1):
            k, k2 = size[t], size[t + 1] if t + 1 < steps else 0
            now = np.ones((k, len(start)))
            if k2:
                ahead = psi[at[:k2, t + 1]] * beta[:k2]
                now[:k2] = ahead @ step.T
                z = (alpha[t][:k2] * now[:k2]).sum(1, keepdims=True)
                move += (alpha[t][:k2].T @ (ahead / z)) * step
                now[:k2] /= now[:k2].sum(1, keepdims=True)
            m = alpha[t] * now
            emit[at[:k, t]] = m / m.sum(1, keepdims=True)
            beta = now

    def decode(self, c: Chains) -> np.ndarray:
        """The most likely label of each item (Viterbi)."""
        out = np.zeros(len(c.row), np.int64)
        s = self.scores(c)
        for _, at in c.groups():
            size = (at >= 0).sum(0).tolist()
            if not size[0]:
                continue
            back, done = [], [self.begin + s[c.row[at[: size[0], 0]]]]
            for t in range(1, at.shape[1]):
                m = done[-1][: size[t], :, None] + self.move
                back.append(m.argmax(1).astype(np.int16))
                done.append(m.max(1) + s[c.row[at[: size[t], t]]])
            label = np.zeros(size[0], np.int64)
            for t in range(at.shape[1] - 1, -1, -1):
                k2 = size[t + 1] if t + 1 < at.shape[1] else 0
                label[k2 : size[t]] = done[t][k2:].argmax(1)
                if k2:
                    label[:k2] = back[t][np.arange(k2), label[:k2]]
                out[at[: size[t], t]] = label[: size[t]]
        return out
