"""Small gradient-boosted trees, lasso logistic regression and isotonic calibration on NumPy arrays.

They fit bounded samples on the driver and score batches inside tasks. Everything is deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Tree:
    """Node i is a leaf if feature[i] < 0; else value < threshold goes to left[i], any other to right[i]."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for x, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            x.append(v)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, threshold, left, right = (np.array(v) for v in (self.feature, self.threshold, self.left, self.right))
        for _ in range(len(self.feature)):
            inner = feature[at] >= 0
            if not inner.any():
                break
            low = x[np.arange(len(x)), np.maximum(feature[at], 0)] < threshold[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return np.array(self.value)[at]

    def paths(self) -> list[tuple[tuple[int, float, bool], ...]]:
        """Conditions (feature, threshold, below) from the root to every other node."""
        out, stack = [], [(0, ())]
        while stack:
            node, path = stack.pop()
            if path:
                out.append(path)
            if self.feature[node] >= 0:
                f, t = self.feature[node], self.threshold[node]
                stack += [(self.left[node], (*path, (f, t, True))), (self.right[node], (*path, (f, t, False)))]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 5.0) -> tuple[float, list[Tree]]:
    """Logistic boosting with histogram splits: (base log-odds, trees)."""
    p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base, out = float(np.log(p / (1 - p))), []
    if not len(y) or y.min() == y.max():
        return base, out
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], 1)
    raw = np.full(len(y), base)
    for _ in range(trees):
        p = sigmoid(raw)
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        tree = Tree()
        stack = [(tree.add(), np.arange(len(y)), 0)]
        while stack:
            node, rows, level = stack.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            tree.value[node] = rate * total_g / (total_h + 1.0)
            if level == depth or len(rows) < 2 * least:
                continue
            best = (1e-4, -1, 0)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                c = codes[rows, f]
                sg, sh, n = (np.bincount(c, w, len(cut) + 1).cumsum()[:-1] for w in (g[rows], h[rows], None))
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain = np.where((n >= least) & (len(rows) - n >= least), gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] < 0:
                continue
            _, f, k = best
            tree.feature[node], tree.threshold[node] = f, float(cuts[f][k])
            tree.left[node], tree.right[node] = tree.add(), tree.add()
            low = codes[rows, f] <= k
            stack += [(tree.left[node], rows[low], level + 1), (tree.right[node], rows[~low], level + 1)]
        raw += tree.predict(x)
        out.append(tree)
    return base, out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient steps; the intercept isn't penalised."""
    n, d = x.shape
    a = np.hstack([np.ones((n, 1)), x])
    size = 4.0 / max(1e-9, np.linalg.norm(a.T @ a / max(n, 1), 2))
    w = z = np.zeros(d + 1)
    t = 1.0
    for _ in range(steps):
        step = z - size * (a.T @ (sigmoid(a @ z) - y)) / max(n, 1)
        new = np.sign(step) * np.maximum(np.abs(step) - size * penalty, 0)
        new[0] = step[0]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: rising scores and the calibrated probability at each; interpolate between."""
    if not len(y):
        return np.array([0.0]), np.array([0.5])
    order = np.lexsort((y, score))
    s, v = score[order], y[order].astype(float)
    stack: list[list[float]] = []  # mean, weight, lowest score, highest score
    for a, b in zip(s, v, strict=True):
        stack.append([b, 1.0, a, a])
        while len(stack) > 1 and (stack[-2][0] >= stack[-1][0] or stack[-2][3] == stack[-1][2]):
            m, w, _, hi = stack.pop()
            q = stack[-1]
            stack[-1] = [(q[0] * q[1] + m * w) / (q[1] + w), q[1] + w, q[2], hi]
    xs = np.array([e for b in stack for e in ((b[2],) if b[2] == b[3] else (b[2], b[3]))])
    ys = np.array([b[0] for b in stack for _ in range(1 if b[2] == b[3] else 2)])
    return xs, ys
