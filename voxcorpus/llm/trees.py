"""Gradient-boosted trees for two classes, small enough to be trained on the driver and sent to the tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 48


@dataclass
class Trees:
    """Boosted trees of logistic loss over binned features.

    A tree of depth d has 2**d - 1 splits (feature, threshold) in heap order and 2**d leaves;
    a row goes right where its feature is over the threshold.
    """

    depth: int = 3
    rounds: int = 60
    rate: float = 0.2
    damping: float = 1.0
    start: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        n, width = x.shape
        w = np.ones(n) if weight is None else weight
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        mean = np.clip((y * w).sum() / w.sum(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        raw = np.full(n, self.start)
        slots = BINS + 1
        columns = np.arange(width) * slots
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = w * (y - p), np.maximum(w * p * (1 - p), 1e-9)
            node = np.zeros(n, int)
            feature = np.zeros(2**self.depth - 1, int)
            threshold = np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                key = ((node - first) * width * slots)[:, None] + columns + binned
                flat, size = key.ravel(), count * width * slots
                gs = np.bincount(flat, np.repeat(g, width), size).reshape(count, width, slots)
                hs = np.bincount(flat, np.repeat(h, width), size).reshape(count, width, slots)
                gl, hl = gs.cumsum(2), hs.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                lam = self.damping
                gain = gl**2 / (hl + lam) + (gt - gl) ** 2 / (ht - hl + lam) - gt**2 / (ht + lam)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                for k in range(count):
                    at = int(gain[k].argmax())
                    f, b = divmod(at, slots)
                    if gain[k].flat[at] > 1e-6 and b < len(cuts[f]):
                        feature[first + k], threshold[first + k] = f, cuts[f][b]
                right = x[np.arange(n), feature[node]] > threshold[node]
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.damping)
            raw += value[leaf]
            self.features.append(feature)
            self.thresholds.append(threshold)
            self.leaves.append(value)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Trees:
        """Fits a slope and an offset of the raw scores on held-out rows (logistic regression with a
        prior of slope 1, offset 0 that counts as much as one row)."""
        z = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-6)
            ga, gb = ((p - y) * z).sum() + (a - 1), (p - y).sum() + b
            haa, hab, hbb = (s * z * z).sum() + 1, (s * z).sum(), s.sum() + 1
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            a, b = max(0.05, a - 0.5 * da), b - 0.5 * db
            if abs(da) + abs(db) < 1e-9:
                break
        self.scale = (float(a), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30)))
