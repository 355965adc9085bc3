"""Gradient-boosted trees for a 0/1 target, on histograms, in numpy. Small, deterministic, sent to executors by broadcast."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of equal depth: for each inner node a feature and a threshold (right if above), for each leaf a value."""

    bias: float
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.bias), np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                at = 2 * at + 1 + (x[row, f[at]] > t[at])
            out += leaf[at - len(f)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting of the log loss. Without rows, or with rows of one class, the model is a constant."""
    n, d = x.shape
    pos = float(y.sum())
    model = Trees(float(np.log((pos + 0.5) / (n - pos + 0.5))))
    if pos in (0, n):
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]).astype(np.int64)
    margin, width = np.full(n, model.bias), bins
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            nodes, base = 2**level, 2**level - 1
            best, cut = np.full(nodes, 1e-6), np.full(nodes, -1)
            total_g, total_h = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
            parent = total_g**2 / (total_h + l2)
            for j in range(d):
                if not len(cuts[j]):
                    continue
                key = at * width + codes[j]
                left_g = np.cumsum(np.bincount(key, g, nodes * width).reshape(nodes, width), 1)[:, : len(cuts[j])]
                left_h = np.cumsum(np.bincount(key, h, nodes * width).reshape(nodes, width), 1)[:, : len(cuts[j])]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - parent[:, None]
                gain[(left_h < least) | (right_h < least)] = -1
                k = gain.argmax(1)
                better = gain[np.arange(nodes), k] > best
                best[better], cut[better] = gain[np.arange(nodes), k][better], k[better]
                feature[base : base + nodes][better] = j
            for v in np.flatnonzero(cut >= 0):
                threshold[base + v] = cuts[feature[base + v]][cut[v]]
            f = feature[base + at]
            at = 2 * at + (x[np.arange(n), f] > threshold[base + at])
        leaf = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        margin += leaf[at]
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.leaves.append(leaf)
    return model
