"""A small linear-chain conditional random field in numpy.

Sequences are lists of active binary features per position. Training maximises
the regularised conditional likelihood of a bounded sample on the driver;
decoding is Viterbi over whole batches of sequences of equal padded length.
"""

from __future__ import annotations

import numpy as np


def pad(sequences: list[list[list[int]]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(features (n, longest, width) with -1 for none, lengths)."""
    n, longest = len(sequences), max([1, *map(len, sequences)])
    x = np.full((n, longest, width), -1, dtype=np.int32)
    for i, s in enumerate(sequences):
        for j, f in enumerate(s):
            x[i, j, : len(f)] = f
    return x, np.array([len(s) for s in sequences])


class CRF:
    """State weights per feature, transition weights, and weights of the first state."""

    def __init__(self, features: int, labels: int) -> None:
        self.w = np.zeros((features + 1, labels))  # the last row stands for no feature
        self.t = np.zeros((labels, labels))
        self.s = np.zeros(labels)

    def scores(self, x: np.ndarray) -> np.ndarray:
        w = self.w.copy()
        w[-1] = 0
        return w[x].sum(axis=2)

    def fit(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, begins: np.ndarray | None = None, epochs: int = 90, rate: float = 0.3, l2: float = 1e-3) -> CRF:
        """Full-batch gradient ascent with adaptive steps; y is padded with 0.

        Sequences that don't begin a text (not ``begins``) say nothing of the first state.
        """
        n, longest, _ = x.shape
        first = np.ones((n, 1)) if begins is None else begins[:, None].astype(float)
        k = len(self.s)
        inside = np.arange(longest)[None] < lengths[:, None]
        params = [self.w, self.t, self.s]
        square = [np.full(p.shape, 1e-6) for p in params]
        eye = np.eye(k)
        kinds, which = np.unique(x[inside], axis=0, return_inverse=True)  # features are few, so most positions look like others
        which = which.reshape(-1)
        gold = eye[y] * inside[..., None]
        gold_t = np.einsum("nla,nlb->ab", gold[:, :-1], gold[:, 1:] * inside[:, 1:, None])
        for _ in range(epochs):
            emit = np.zeros((n, longest, k))
            emit[inside] = self.w[kinds].sum(axis=1)[which]
            e = np.exp(emit - emit.max(axis=2, keepdims=True))
            move, start = np.exp(self.t), np.exp(self.s * first)
            a, b, scale = np.empty((longest, n, k)), np.ones((longest, n, k)), np.ones((longest, n, 1))
            e, within = np.ascontiguousarray(e.transpose(1, 0, 2)), inside.T[:, :, None]
            a[0] = start * e[0]
            a[0] /= a[0].sum(axis=1, keepdims=True)
            for j in range(1, longest):  # forward, each step scaled to add up to 1
                step = (a[j - 1] @ move) * e[j]
                scale[j] = step.sum(axis=1, keepdims=True)
                a[j] = np.where(within[j], step / scale[j], a[j - 1])
            for j in range(longest - 2, -1, -1):
                b[j] = np.where(within[j + 1], (e[j + 1] * b[j + 1]) @ move.T / scale[j + 1], 1)
            p = (a * b).transpose(1, 0, 2)
            p = p / p.sum(axis=2, keepdims=True) * inside[..., None]
            grad_w = np.zeros_like(self.w)
            diff = gold - p
            mass = np.stack([np.bincount(which, weights=diff[inside][:, c], minlength=len(kinds)) for c in range(k)], axis=1)
            np.add.at(grad_w, kinds.reshape(-1), np.repeat(mass, kinds.shape[1], axis=0))
            grad_w[-1] = 0
            expect = np.zeros_like(self.t)
            for j in range(1, longest):
                expect += move * (a[j - 1].T @ (e[j] * b[j] / scale[j] * within[j]))
            grads = [grad_w / n - l2 * self.w, (gold_t - expect) / n - l2 * self.t, (diff[:, 0] * first).sum(axis=0) / n - l2 * self.s]
            for p_, g, q in zip(params, grads, square):
                q += g * g
                p_ += rate * g / np.sqrt(q)
        return self

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Most likely labels (n, longest); meaningless behind a sequence's end."""
        return self.best(self.scores(x), lengths)

    def best(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Most likely labels by the scores of each position."""
        n, longest, _ = emit.shape
        best, back = self.s + emit[:, 0], np.zeros((n, longest, len(self.s)), dtype=np.int32)
        for j in range(1, longest):
            total = best[:, :, None] + self.t[None]
            back[:, j] = total.argmax(axis=1)
            best = np.where((j < lengths)[:, None], total.max(axis=1) + emit[:, j], best)
        out = np.zeros((n, longest), dtype=np.int32)
        now = best.argmax(axis=1)
        for j in range(longest - 1, -1, -1):
            last = j >= lengths
            out[:, j] = now
            if j:
                now = np.where(last, now, back[np.arange(n), j, now])
        return out

