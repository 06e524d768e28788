"""Gradient-boosted trees with logistic loss, and isotonic calibration, in numpy.

Trees are of fixed depth over quantile bins; they are small enough to be sent to
every task.  Fitting is deterministic.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Isotonic:
    """Non-decreasing fit by pooling adjacent violators; linear between block centres.

    A thousandth of the score is the squashed input itself, so that equal
    calibrated values keep their order.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.argsort(x, kind="stable")
        x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
        blocks: list[list[float]] = []  # sum of y, count, sum of x
        for a, b in zip(x, y, strict=True):
            blocks.append([b, 1.0, a])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
        self.at = np.array([b[2] / b[1] for b in blocks] or [0.0])
        # a block of n rows is shrunk towards 1/2 as if one more row of each label had been half seen
        self.level = np.maximum.accumulate(np.array([(b[0] + 0.25) / (b[1] + 0.5) for b in blocks] or [0.5]))
        self.middle = float(np.median(x)) if len(x) else 0.0
        self.scale = float(np.std(x)) + 1e-9 if len(x) else 1.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(0.999 * np.interp(x, self.at, self.level) + 0.001 * sigmoid((x - self.middle) / self.scale), 0, 1)


class Boosted:
    """rounds trees of the given depth; call with rows of features to get log-odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 32, l2: float = 1.0, least: float = 5.0):
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.depth, self.rate = depth, rate
        rate0 = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate0 / (1 - rate0)))
        binned = self._bins(x)
        score = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(rounds if len(y) else 0):
            p = sigmoid(score)
            tree, leaf = self._tree(binned, p - y, p * (1 - p), l2, least)
            self.trees.append(tree)
            score += self.rate * tree[2][leaf]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def _tree(self, binned, grad, hess, l2, least):
        nodes = 2**self.depth
        feature, cut = np.zeros(nodes, int), np.full(nodes, 1 << 30)
        at = np.ones(len(grad), int)
        width = max(len(e) for e in self.edges) + 1
        for level in range(self.depth):
            lo, count = 2**level, 2**level
            best = np.full(count, 1e-6)
            for j in range(binned.shape[1]):
                key = (at - lo) * width + binned[:, j]
                g = np.bincount(key, grad, count * width).reshape(count, width)
                h = np.bincount(key, hess, count * width).reshape(count, width)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                g_all, h_all = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gr, hr = g_all - gl, h_all - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g_all**2 / (h_all + l2)
                gain[(hl < least / 10) | (hr < least / 10)] = -1
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                better = top > best
                best[better] = top[better]
                feature[lo : lo + count][better] = j
                cut[lo : lo + count][better] = k[better]
            at = 2 * at + (binned[np.arange(len(at)), feature[at]] > cut[at])
        leaf = at - nodes
        g, h = np.bincount(leaf, grad, nodes), np.bincount(leaf, hess, nodes)
        return (feature, cut, -g / (h + l2)), leaf

    def __call__(self, x: np.ndarray) -> np.ndarray:
        binned = self._bins(np.asarray(x, float))
        out = np.full(len(binned), self.base)
        rows = np.arange(len(binned))
        for feature, cut, value in self.trees:
            at = np.ones(len(binned), int)
            for _ in range(self.depth):
                at = 2 * at + (binned[rows, feature[at]] > cut[at])
            out += self.rate * value[at - 2**self.depth]
        return out
